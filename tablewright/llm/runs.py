"""Periodic runs of words: stretches that repeat one phrase three times or more.

Words are bytes between blanks (space and U+0009 to U+000D). At dyadic scales each text is
cut into blocks of L words. The sum of squared differences between a block and the words at
every distance of its window is computed exactly, as a correlation by a number-theoretic
transform in matrix products; where it is zero, the block occurs again. Those distances seed
extensions to both sides, and the stretches long enough for their distance are the runs.

Why no run is missed: a run of smallest period q holds at least 2q words that equal the word
q later. Distances from L to 2L - 1 are looked up with blocks of L words, and any 2L - 1
words hold a whole block, aligned at multiples of L; below 8 a run's 24 words do the same
for blocks of 8.

Exactness: word numbers are folded below a bound that keeps every sum under the prime, so the
residue is the sum itself. Folding can only add seeds; seeds and extensions are compared by
two fingerprints of the words, and every run is compared word by word before it is returned.

Defined results: a null or blank text has no words, no runs and an empty ``collapsed``; rows are
worked on one by one, so repeated rows and null ids give rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.llm.shared import sliced

LEAST_WORDS, LEAST_TIMES = 24, 3
SMALLEST, LARGEST = 8, 1 << 19  # words of a block
PRIME, GENERATOR = 7 * (1 << 20) + 1, 3
_DIRECT = 64  # transforms up to this size are one matrix product
_CHUNK = 1 << 17  # numbers of one matrix
_MARKS = ((2_147_483_629, 1_103_515_245), (2_147_483_587, 1_664_525_713))  # primes and bases of the fingerprints
_GROUP_WORDS = 200_000  # texts are worked on together up to this many words


def _reduced(x: np.ndarray) -> np.ndarray:
    """The residues nearest zero, in place."""
    x -= np.rint(x * (1 / PRIME)) * PRIME
    return x


@cache
def _powers(n: int, back: bool) -> np.ndarray:
    """Powers of an n-th root of one, as residues nearest zero."""
    root = pow(GENERATOR, (PRIME - 1) // n * (n - 1 if back else 1), PRIME)
    out = np.ones(n, np.int64)
    size = 1
    while size < n:  # each half from the one before
        out[size:2 * size] = out[:size] * pow(root, size, PRIME) % PRIME
        size *= 2
    return np.where(out > PRIME // 2, out - PRIME, out).astype(np.float64)


@cache
def _matrix(n: int, back: bool) -> np.ndarray:
    k = np.arange(n)
    m = _powers(n, back)[np.outer(k, k) % n]
    return _reduced(m * pow(n, -1, PRIME)) if back else m


@cache
def _twist(n1: int, n2: int, back: bool) -> np.ndarray:
    return _powers(n1 * n2, back)[np.outer(np.arange(n1), np.arange(n2))][:, :, None]


def _split(n: int) -> tuple[int, int]:
    n1 = min(_DIRECT, 1 << (n.bit_length() - 1) // 2)
    return n1, n // n1


def forward(x: np.ndarray) -> np.ndarray:
    """Transform along the middle axis of (batch, n, columns); the result comes in an order of its own."""
    b, n, r = x.shape
    if n <= _DIRECT:
        return _reduced(np.matmul(_matrix(n, False), x))
    n1, n2 = _split(n)
    y = _reduced(np.matmul(_matrix(n1, False), x.reshape(b, n1, n2 * r))).reshape(b, n1, n2, r)
    return forward(_reduced(y * _twist(n1, n2, False)).reshape(b * n1, n2, r)).reshape(b, n, r)


def inverse(z: np.ndarray) -> np.ndarray:
    """What ``forward`` transformed."""
    b, n, r = z.shape
    if n <= _DIRECT:
        return _reduced(np.matmul(_matrix(n, True), z))
    n1, n2 = _split(n)
    y = _reduced(inverse(z.reshape(b * n1, n2, r)).reshape(b, n1, n2, r) * _twist(n1, n2, True))
    return _reduced(np.matmul(_matrix(n1, True), y.reshape(b, n1, n2 * r))).reshape(b, n, r)


def occurrences(words: np.ndarray, at: np.ndarray, size: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) where the block of ``size`` words equals the words at a distance from ``far`` to ``far + size - 1``.

    Equal as far as the folded word numbers tell. ``words`` goes on for ``far + 2 * size`` after the last start.
    """
    fold = isqrt(PRIME // size)
    label = (words % fold).astype(np.float64)
    squares = np.concatenate([[0.0], np.cumsum(label * label)])
    n = 2 * size
    rows, ahead, turned = np.arange(n)[:, None], np.arange(size)[:, None], np.arange(size - 1, 0, -1)[:, None]
    starts, gaps = [], []
    width = max(1, _CHUNK // n)
    for k in range(0, len(at), width):
        b = at[k:k + width]
        window, block = label[b + far + rows], np.zeros((n, len(b)))
        block[0], block[size + 1:] = label[b], label[b + turned]  # at minus j, for a correlation
        both = inverse(_reduced(forward(window[None]) * forward(block[None])))[0, :size]
        there = b + far + ahead
        apart = (squares[b + size] - squares[b]) + (squares[there + size] - squares[there]) - 2 * both
        t, r = np.nonzero(_reduced(apart) == 0)
        starts.append(b[r])
        gaps.append(far + t)
    return (np.concatenate(starts), np.concatenate(gaps)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Prints:
    """Fingerprints of stretches of ``words``, for many comparisons at once."""

    def __init__(self, words: np.ndarray):
        self.of = []
        for prime, base in _MARKS:
            power = np.ones(len(words) + 1, np.int64)
            size = 1
            while size < len(power):
                part = power[size:2 * size]
                part[:] = power[:len(part)] * pow(base, size, prime) % prime
                size *= 2
            value = (words + 1) * 2_654_435_761 % prime
            self.of.append((prime, power, np.concatenate([[0], np.cumsum(value * power[:-1] % prime) % prime])))

    def equal(self, at: np.ndarray, gap: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from ``at`` equal those ``gap`` later."""
        out = np.ones(len(at), bool)
        for prime, power, total in self.of:
            here, there = (total[at + n] - total[at]) % prime, (total[at + gap + n] - total[at + gap]) % prime
            out &= here * power[gap] % prime == there
        return out

    def reach(self, at: np.ndarray, gap: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """How many words, at most ``most``, after (or before) ``at`` equal those ``gap`` later."""
        got = np.zeros(len(at), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            n = got + step
            can = np.flatnonzero(n <= most)
            same = self.equal(at[can] + (got[can] if sign > 0 else -n[can]), gap[can], np.full(len(can), step))
            got[can[same]] += step
            step >>= 1
        return got


def _walk(words: np.ndarray, at: int, gap: int, most: int, sign: int) -> int:
    """The same as ``reach``, word by word."""
    got = 0
    while got < most and words[at + (got if sign > 0 else -got - 1)] == words[at + gap + (got if sign > 0 else -got - 1)]:
        got += 1
    return got


def _windows(longest: int) -> Iterator[tuple[int, int]]:
    """Words of a block and least distance of its window: together every distance up to a third of ``longest``, each once."""
    yield SMALLEST, 0
    scale = SMALLEST
    while LEAST_TIMES * scale <= longest:
        size = min(scale, LARGEST)
        for far in range(scale, 2 * scale, size):
            yield size, far
        scale *= 2


def runs_of(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs in texts that lie behind each other in ``words``.

    ``begin`` and ``end`` are the texts' bounds; starts and ends are places in ``words``.
    """
    length = end - begin
    if not len(length) or length.max() < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    prints, seeds = _Prints(words), []
    for size, far in _windows(int(length.max())):
        padded = np.concatenate([words, np.zeros(far + 2 * size, np.int64)])
        long = np.flatnonzero(length >= max(LEAST_WORDS, LEAST_TIMES * far))
        number = np.maximum(0, (length[long] - max(far, 1)) // size)
        place, text = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number), np.repeat(long, number)
        b, gap = occurrences(padded, begin[text] + place * size, size, far)
        text = np.searchsorted(begin, b, "right") - 1
        fits = (gap > 0) & (b + gap + size <= end[text])
        b, gap, text = b[fits], gap[fits], text[fits]
        same = prints.equal(b, gap, np.full(len(b), size))
        b, gap, text = b[same], gap[same], text[same]
        order = np.lexsort((b, gap))
        b, gap, text = b[order], gap[order], text[order]
        # A block right behind one that occurs at the same distance lies in the same stretch.
        new = np.ones(len(b), bool)
        new[1:] = (gap[1:] != gap[:-1]) | (b[1:] != b[:-1] + size) | (text[1:] != text[:-1])
        seeds.append((b[new], gap[new], begin[text[new]], end[text[new]]))
    b, gap, low, high = (np.concatenate(x) for x in zip(*seeds, strict=True))
    for reach in (prints.reach, np.vectorize(lambda at, gap, most, sign: _walk(words, at, gap, most, sign), otypes=[np.int64])):
        if not len(b):
            break
        first, last = b - reach(b, gap, b - low, -1), b + gap + reach(b, gap, high - b - gap, 1)
        ok = np.flatnonzero(last - first >= np.maximum(LEAST_WORDS, LEAST_TIMES * gap))
        ok = ok[np.lexsort((gap[ok], last[ok], first[ok]))]
        found = np.stack([first[ok], last[ok], gap[ok]], axis=1)
        # Multiples of the smallest period give the same stretch.
        one = np.ones(len(found), bool)
        one[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[one]
        if all(np.array_equal(words[s:e - q], words[s + q:e]) for s, e, q in found.tolist()):
            return found
    return np.zeros((0, 3), np.int64)


def _worked(texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Number of words, runs as (start, length, period), and the text without repeats, of each text."""
    number: dict[bytes, int] = {}
    split = [(t or b"").split() for t in texts]
    counts = [len(w) for w in split]
    flat = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, sum(counts))
    end = np.cumsum(np.array(counts, np.int64))
    # Texts without words would share their bounds with the next one.
    full = np.flatnonzero(np.array(counts))
    begin = end - np.array(counts, np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    out = [b" ".join(ws) for ws in split] if not len(full) else None
    runs = runs_of(flat, begin[full], end[full])
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    gone = np.cumsum(gone) > 0
    owner = full[np.searchsorted(begin[full], runs[:, 0], "right") - 1] if len(full) else []
    for k, (s, e, q) in zip(owner, runs.tolist(), strict=True):
        found[k].append((s - int(begin[k]), e - s, q))
    if out is None:
        out = [b" ".join(ws if not own else [w for w, g in zip(ws, gone[b:], strict=False) if not g])
               for ws, own, b in zip(split, found, begin.tolist(), strict=True)]
    return counts, [sorted(f, key=lambda r: (r[0], r[2])) for f in found], out


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the words without any run's repeats, of every row."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T._parse_datatype_string(_RUN)), T.StructField("collapsed", T.StringType())])
    nested = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of the batch of about as many bytes as the words of a group have."""
        sizes = np.cumsum([len(x or b"") for x in batch.column(1).to_pylist()])
        start = 0
        while start < batch.num_rows:
            so_far = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, so_far + 6 * _GROUP_WORDS, "right")))
            yield batch.slice(start, stop - start)
            start = stop

    def run(batches):
        for batch in sliced(batches, 2_000):
            for part in groups(batch):
                counts, found, collapsed = _worked(part.column(1).to_pylist())
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, nested), pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def longest(runs) -> Column:
    """The run with the greatest exact length/period; of equal ones the first, then that of the smaller period; null without runs."""
    def better(best, r):
        ours, theirs = r["length"] * best["period"], best["length"] * r["period"]
        first = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (ours > theirs) | ((ours == theirs) & first), r).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
