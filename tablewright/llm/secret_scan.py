"""Secret scan: fixed patterns, and a battery of randomness tests for what no pattern names.

Long tokens are tested in the encoding their characters suggest. Chi-squared asks for an even
use of the alphabet, over cells large enough for short tokens: each case and the digits, letters
that are frequent in prose apart from rare ones. A runs test asks whether vowels come as often
next to each other as they would by chance, and the serial correlation of neighbouring symbols
does the same for their places in the alphabet. The three p-values are combined; the higher
the result, the more the token looks drawn at random.

What ordinary text reaches is learned from decoys, one an encoding for each document: words of
the text itself, from a place and up to a length that its checksum chooses, joined as names are
in that encoding (capitalised, with the text's numbers or one from the checksum between them).
Per encoding and length class the share of decoys that reach a token's value is the token's
chance of being ordinary text, and a step-up rule over all tokens of the class keeps the
expected share of false finds at ``rate``. Only counts by class and value reach the driver.

Defined results: a null text counts as empty and has no spans; positions are code points,
end exclusive; spans come by start, then kind as in ``KINDS``; random tokens that touch a
pattern's span are not listed again.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.shared import sliced, stage

KINDS = ("assign", "access", "hex", "random")
# The patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LONG = 20
#: Encodings: name, symbols in order.
ENCODINGS = (
    ("hex", "0123456789abcdef"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("two-case", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
)
_INDEX = [{c: k for k, c in enumerate(symbols)} for _, symbols in ENCODINGS]
_VOWELS, _FREQUENT = set("aeiou"), set("tnsrhldc")


def _cell(c: str) -> tuple:
    """Cell of a symbol: digits; by case, vowels, consonants frequent in prose, and the others."""
    return ("digit",) if c.isdigit() else (c.islower(), 0 if c.lower() in _VOWELS else 1 if c.lower() in _FREQUENT else 2)


def _cells(symbols: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol its cell and whether it is a vowel; of each cell its share of the symbols."""
    names = sorted({_cell(c) for c in symbols}, key=str)
    of = np.array([names.index(_cell(c)) for c in symbols])
    return of, np.array([c.lower() in _VOWELS for c in symbols]), np.bincount(of) / len(symbols)


_CELLS = [_cells(symbols) for _, symbols in ENCODINGS]
LENGTHS = (20, 24, 32, 40, 56, 80)  # lower ends of the length classes
BINS = 48  # of the combined p-value, four a power of ten


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost without overlap per kind; what is too short is dropped."""
    spans = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _has_long(text):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return spans


def _has_long(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= LONG


def encoding_of(token: str) -> tuple[int, str] | None:
    """Index of the smallest fitting encoding and the token's symbols; None for digits alone."""
    core = re.sub(r"[-_/+=]", "", token)
    if len(core) < LONG or core.isdigit():
        return None
    folded = core.lower()
    if re.fullmatch(r"[0-9a-f]+", folded) and (core == folded or core == core.upper()) and re.search("[0-9]", core):
        return 0, folded
    if core.isalpha():
        return (2, folded) if core in (folded, core.upper()) else (3, core)
    if re.fullmatch(r"[A-Z2-7]+", core):
        return 1, core
    if core in (folded, core.upper()):
        return 4, folded
    return 5, core


def battery(x: np.ndarray, code: int) -> float:
    """Combined p-value of the symbols ``x`` being drawn evenly and independently from an encoding."""
    n = len(x)
    of, vowel, share = _CELLS[code]
    counts, df = np.bincount(of[x], minlength=len(share)), len(share) - 1
    chi = float((counts * counts / share).sum()) / n - n
    z = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    even = 0.5 * math.erfc(z / math.sqrt(2))
    high = vowel[x]
    a = int(high.sum())
    b = n - a
    runs_p = 1.0  # without both kinds the first test has said it all
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    d = x - x.mean()
    square = float(d @ d)
    r = float(d[1:] @ d[:-1]) / square if square else 1.0
    serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    half = -sum(math.log(max(p, 1e-300)) for p in (even, runs_p, serial))
    return math.exp(-half) * (1 + half + half * half / 2) if half < 600 else 0.0


def value_bin(p: float) -> int:
    return max(0, min(BINS - 1, BINS - 1 + math.floor(4 * math.log10(p)))) if p > 0 else 0


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, class, bin) of the long tokens outside the base spans."""
    out = []
    if not _has_long(text):
        return out
    for m in TOKEN.finditer(text):
        found = encoding_of(m[0])
        if not found or any(s < m.end() and m.start() < e for _, s, e in base):
            continue
        code, core = found
        x = np.array([_INDEX[code].get(c, 0) for c in core])
        out.append((m.start(), m.end(), code * len(LENGTHS) + length_class(len(core)), value_bin(battery(x, code))))
    return out


_NAME = re.compile(r"[A-Za-z]+|[0-9]+")


def _written(words: list[str], code: int, number: str) -> str:
    """Words joined as names of that encoding are; ``number`` comes in where the encoding has digits and the words have none."""
    name = ENCODINGS[code][0]
    if name in ("letters", "two-case"):
        words = [w for w in words if w.isalpha()]
    elif not any(w.isdigit() for w in words):
        words = [*words[:1], number, *words[1:]]
    if name in ("two-case", "base62"):
        return "".join(w[:1].upper() + w[1:] for w in words)
    text = "".join(words)
    return text.upper() if name == "base32" else text.lower()


def decoys(text: str) -> list[tuple[int, int]]:
    """(class, bin) of the text's own words, written in each encoding; length and place follow its checksum."""
    check = zlib.crc32(text.encode("utf-8", "replace"))
    size = check % len(LENGTHS)
    n, number, out = LENGTHS[size], str(check // 64 % 10_000), []
    at = check // 8 % max(1, len(text) - 12 * n)
    at = 0 if not at else text.find(" ", at) + 1  # whole words
    words = _NAME.findall(text[at:at + 12 * n])
    for code in range(len(ENCODINGS)):
        symbols = [k for c in _written(words, code, number) if (k := _INDEX[code].get(c)) is not None][:n]
        if len(symbols) == n:
            out.append((code * len(LENGTHS) + size, value_bin(battery(np.array(symbols), code))))
    return out


def cut_offs(tokens: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Least accepted bin of each class by a step-up rule inside the class.

    A token's chance is the share of decoys that reach its bin, of its own encoding and of
    its own or a shorter length: shorter text looks more random, so they only make it larger.
    """
    out: dict[int, int] = {}
    for c in {c for c, _ in tokens}:
        own = {b: n for (k, b), n in tokens.items() if k == c}
        null = np.zeros(BINS)
        for (k, b), n in ordinary.items():
            if k // len(LENGTHS) == c // len(LENGTHS) and k <= c:
                null[b] += n
        everything, so_far = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            so_far += own[b]
            chance = (1 + null[b:].sum()) / (1 + null.sum())
            if everything * chance <= rate * so_far:
                out[c] = b
    return out


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``doc_id, spans`` (array of kind, start, end) of every row."""
    kind = docs.schema["doc_id"].dataType
    long = T.LongType()
    numbers = T.ArrayType(long)
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("base", T.ArrayType(numbers)),
                           T.StructField("maybe", T.ArrayType(numbers)), T.StructField("decoys", T.ArrayType(numbers))])
    kinds = {k: i for i, k in enumerate(KINDS)}

    def scan(batches):
        nested = pa.list_(pa.list_(pa.int64()))
        for batch in sliced(batches):
            base, maybe, null = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append([(kinds[k], s, e) for k, s, e in own])
                maybe.append(candidates(text, own))
                null.append(decoys(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, nested), pa.array(maybe, nested),
                                              pa.array(null, nested)], names=schema.names)

    scanned = stage(docs.select("doc_id", "text").mapInArrow(scan, schema), "tokens")
    token = scanned.select(F.explode("maybe").alias("m")).select(F.lit(0).alias("side"), F.col("m")[2].alias("class"), F.col("m")[3].alias("bin"))
    other = scanned.select(F.explode("decoys").alias("m")).select(F.lit(1).alias("side"), F.col("m")[0].alias("class"), F.col("m")[1].alias("bin"))
    counts: list[dict] = [{}, {}]
    for r in token.unionAll(other).groupBy("side", "class", "bin").count().collect():  # at most 2 x 36 x 48 rows
        counts[r["side"]][r["class"], r["bin"]] = r["count"]
    least = cut_offs(*counts, rate)

    def chosen(batches):
        for batch in batches:
            spans = []
            for base, maybe in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [(s, k, e) for k, s, e in base] + [(s, kinds["random"], e) for s, e, c, b in maybe if b >= least.get(c, BINS)]
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own)])
            typed = pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), typed], names=["doc_id", "spans"])

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("spans", T._parse_datatype_string(_SPAN))])
    return scanned.select("doc_id", "base", "maybe").mapInArrow(chosen, out)


def joined(spans) -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
