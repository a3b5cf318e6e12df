"""Packing by minimum bin slack.

Documents become token ids (written once, as 16-bit numbers where the vocabulary allows).
Whole windows are cut off long documents; what remains has a length below the window. How
many pieces there are of each length is all the plan needs: window by window, subset sums
over a bitset find the fill closest to the window that holds the longest remaining length,
going back through the bitsets gives how many pieces of each length it takes, and the same
fill is used for as many windows as the counts allow. When no fill is exact, one more piece
is cut at the gap and its tail goes back to the counts. The last window is cut into powers
of two, which need no padding. The plan is a table of at most a few thousand rows whatever
the size of the corpus; pieces find their place by their rank among those of equal length,
which is counted per partition and never sorts all rows in one task.

Defined results: a null or empty text has the end id only; repeated rows are packed each;
null ids stay null.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.llm.shared import sliced, stage

END_ID = 1
_WORDS_KEPT = 500_000
_SPACES = " \n\t\r"
_DROP = {ord(c): None for c in _SPACES}
_LATIN = re.compile("[\x00-\u024f]*").fullmatch
# Fixed value: the splitting rule of byte-level BPE files.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


class _Words(dict):
    """Ids, as bytes, of words that follow a single blank (or begin with a line break); encoded once."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word if word[0] == "\n" else " " + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file whose merges come in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    plain = (model.get("type") == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout"))
    if not plain or ids != sorted(set(ids)) or -1 in ids:
        return None
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]  # printable bytes stand for themselves
    code = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(code[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file.

    The tokenizer's own splitting never joins what stands before a single blank or a line
    break with what follows it, so texts are cut there, and the words, most of which come
    again, are encoded once. Where the file's merges come in the order of their ids, words
    in Latin letters are merged by rank, which gives the same ids faster; all other words,
    special tokens, and texts with unusual white space go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.type == "<u2" else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.other = _Words(self._fast()), {}

    def _fast(self):
        ranks, slow, code = _ranks(self.path), self._slow, self.code
        if ranks is None:
            return slow
        merge = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special, latin = self.special, _LATIN

        def encode(piece: str) -> bytes:
            if latin(piece) and not ("<" in piece and any(x in piece for x in special)):
                return array(code, merge(piece)).tobytes()
            return slow(piece)

        return encode

    def _slow(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        words = text.split()
        if words and " ".join(words) == text.replace("\n", " "):  # single blanks and line breaks between words only
            first, *keys = text.replace("\n", " \n").split(" ")
            return np.frombuffer(self._slow(first) + b"".join(map(self.known.__getitem__, keys)), self.type)
        if words and "".join(words) == text.translate(_DROP):
            return np.frombuffer(b"".join(map(self._one, _CHUNK.findall(text))), self.type)
        return np.frombuffer(self._slow(text), self.type)

    def _one(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[0] == " " and piece[1] not in _SPACES:
            return self.known[piece[1:]]
        if len(self.other) > _WORDS_KEPT:
            self.other.clear()
        got = self.other.get(piece)
        if got is None:
            got = self._slow(piece)
            if len(piece) <= 64:
                self.other[piece] = got
        return got


@dataclass
class Plan:
    """Where the pieces of each length go: rows of ``COLUMNS``, sorted by length and first rank.

    Ranks ``first`` up to ``count`` of a length go ``per`` a sequence from ``sequence`` on, from
    ``offset`` on. Where ``tail`` is not 0, only the first ``take`` ids go there, and the rest
    is the piece of rank ``tail_first`` and on of length ``tail``.
    """

    COLUMNS = ("length", "first", "count", "per", "sequence", "offset", "take", "tail", "tail_first")
    rows: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray):
        """Yields (index, start in the piece, ids, sequence, offset, cut) until all is placed."""
        index, begin = np.arange(len(length)), np.zeros(len(length), np.int64)
        cut = np.zeros(len(length), bool)
        keys = (self.rows[:, 0] << 45) + self.rows[:, 1]
        while len(index):
            row = self.rows[np.searchsorted(keys, (length << 45) + rank, "right") - 1]
            _, first, _, per, sequence, offset, take, tail, tail_first = row.T
            t, i = (rank - first) // per, (rank - first) % per
            more = tail > 0
            yield index, begin, take, sequence + t, offset + i * length, cut | more
            index, begin, cut = index[more], (begin + take)[more], np.ones(more.sum(), bool)
            length, rank = tail[more], (tail_first + t)[more]


def best_fill(left: np.ndarray, room: int) -> dict[int, int]:
    """How many pieces of each length come closest to ``room``: subset sums over a bitset, traced back."""
    reach, mask, items = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        n, k = min(int(left[length]), room // length), 1
        while n:
            k = min(k, n)
            n -= k
            items.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            k *= 2
        if reach >> room & 1:
            break
    target, picked = reach.bit_length() - 1, {}
    for length, k, before in reversed(items):
        if not before >> target & 1:
            target -= length * k
            picked[length] = picked.get(length, 0) + k
    return picked


def plan(counts: np.ndarray, window: int) -> Plan:
    """Pack pieces, ``counts[length]`` of each length below ``window``."""
    left = np.zeros(window, np.int64)
    left[: len(counts)] = counts
    total, used, rows, sequence = left.copy(), np.zeros(window, np.int64), [], 0
    lengths = np.arange(window)

    def put(length: int, times: int, per: int, at: int, take: int = 0) -> None:
        """Use up ``times * per`` pieces; with ``take`` only their heads, and the tails come back."""
        tail = length - take if take else 0
        rows.append((length, used[length], times * per, per, sequence, at, take or length, tail, total[tail] if tail else 0))
        used[length] += times * per
        left[length] -= times * per
        if tail:
            total[tail] += times
            left[tail] += times

    while int(left @ lengths) >= window:
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        picked = best_fill(left, window - top)
        left[top] += 1
        picked[top] = picked.get(top, 0) + 1
        gap = window - sum(length * k for length, k in picked.items())
        times = min(int(left[length]) // k for length, k in picked.items())
        cut = 0
        if gap:  # every piece not picked is longer than the gap
            spare = left.copy()
            for length, k in picked.items():
                spare[length] -= k * times
            if not spare.any():
                times = max(1, times - 1)
                spare = left.copy()
                for length, k in picked.items():
                    spare[length] -= k * times
            cut = int(spare.argmax())
            times = min(times, int(left[cut]) // (picked.get(cut, 0) + 1), *(int(left[n]) // k for n, k in picked.items() if n != cut))
        at = 0
        for length in sorted(picked, reverse=True):
            put(length, times, picked[length], at)
            at += length * picked[length]
        if gap:
            put(cut, times, 1, at, gap)
        sequence += times
    rest, at = int(left @ lengths), 0
    size = 1 << (rest.bit_length() - 1) if rest else 0
    while rest:  # the last window: sequences of a power of two each
        length = int(np.flatnonzero(left)[-1])
        take = min(length, size - at)
        put(length, 1, 1, at, take if take < length else 0)
        at, rest = at + take, rest - take
        if at == size:
            sequence, at = sequence + 1, 0
            size = 1 << (rest.bit_length() - 1) if rest else 0
    table = np.array(rows or np.zeros((0, 9)), np.int64).reshape(-1, 9)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], sequence)


def token_table(docs: DataFrame, path: str, window: int, end_id: int = END_ID) -> DataFrame:
    """``at, doc_id, n, crcs, ids`` of every row; crcs of its whole windows and of what remains."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("doc_id", kind), T.StructField("n", T.LongType()),
                           T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())])

    def run(batches):
        encode = Encoder(path)
        end = np.array([end_id], encode.type)
        for batch in sliced(batches):
            ids = [np.concatenate([encode(t or ""), end]) for t in batch.column(2).to_pylist()]
            crcs = [[zlib.crc32(x[s:s + window].astype("<u4")) for s in range(0, len(x), window)] for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(crcs, pa.list_(pa.int64())), pa.array([x.tobytes() for x in ids], pa.binary())], names=schema.names)

    return docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 2_048, end_id: int = END_ID) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return _pieces(stage(token_table(docs, tokenizer, window, end_id), "tokens"), window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_ids(docs: DataFrame, tokenizer: str, window: int = 2_048, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids`` (array of int), for a training reader."""
    tokens = stage(token_table(docs, tokenizer, window, end_id), "tokens")
    pieces = _pieces(tokens, window).select("at", "start", "length", "sequence_id", "offset")
    cut = F.struct("offset", F.slice("all", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))

    def widen(batches):
        for batch in batches:
            ids = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype(np.int32) for b, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["at", "all"])

    wide = tokens.select("at", "ids", "n").mapInArrow(widen, "at bigint, all array<int>")
    return (pieces.join(wide, "at").groupBy("sequence_id").agg(F.array_sort(F.collect_list(cut)).alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")))


def _pieces(tokens: DataFrame, window: int) -> DataFrame:
    whole = F.floor(F.col("n") / window).cast("bigint")
    base = tokens.select("at", "doc_id", "n", "crcs", F.shiftright("at", 33).alias("part"), whole.alias("whole"), (F.col("n") % window).alias("rest"))
    units = base.filter("whole > 0").select("at", "doc_id", "n", "part", F.lit(window).cast("bigint").alias("length"), F.col("whole").alias("weight"),
                                            F.expr("slice(crcs, 1, int(whole))").alias("crcs"))
    units = units.unionAll(base.filter("rest > 0").select("at", "doc_id", "n", "part", F.col("rest").alias("length"), F.lit(1).cast("bigint").alias("weight"),
                                                          F.expr("slice(crcs, -1, 1)").alias("crcs")))
    # Counts of each length in each written part, then the rank of a part's first piece of that length.
    by_part = stage(units.groupBy("part", "length").agg(F.sum("weight").alias("n_here")), "lengths")
    counts = np.zeros(window, np.int64)
    wholes = 0
    for r in by_part.groupBy("length").agg(F.sum("n_here").alias("n")).collect():  # at most one row a length
        if r["length"] == window:
            wholes = r["n"]
        else:
            counts[r["length"]] = r["n"]
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a part and length, so it grows with the table: merged, never broadcast; the units are dealt by the same keys already.
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n_here").over(ahead), F.lit(0)).alias("ahead")).hint("merge")
    here = Window.partitionBy("part", "length").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.withColumn("before", F.coalesce(F.sum("weight").over(here), F.lit(0))).join(offsets, ["part", "length"]).select(
        "at", "doc_id", "n", "length", "weight", "crcs", (F.col("ahead") + F.col("before")).alias("rank"))
    shared_plan = tokens.sparkSession.sparkContext.broadcast(plan(counts, window))
    kind = tokens.schema["doc_id"].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("at", long), T.StructField("doc_id", kind), T.StructField("doc_tokens", long), T.StructField("start", long),
                           T.StructField("length", long), T.StructField("sequence_id", long), T.StructField("offset", long),
                           T.StructField("ids_crc32", long), T.StructField("cut", T.BooleanType())])

    def run(batches):
        rows = shared_plan.value
        for batch in batches:
            n, length, weight, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 6))
            crcs = batch.column(5)
            flat = crcs.flatten().to_numpy(zero_copy_only=False)
            first_crc = np.concatenate([[0], np.cumsum(weight)[:-1]]) if len(weight) else weight

            def made(index, start, size, sequence, offset, crc, cut, batch=batch, n=n):
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index)), pa.array(n[index]), pa.array(start), pa.array(size),
                     pa.array(sequence), pa.array(offset), pa.array(crc), pa.array(cut)], names=schema.names)

            full = np.flatnonzero(length == window)
            index = np.repeat(full, weight[full])
            step = np.arange(len(index)) - np.repeat(np.cumsum(weight[full]) - weight[full], weight[full])
            zero = np.zeros(len(index), np.int64)
            yield made(index, step * window, zero + window, rank[index] + step, zero, flat[first_crc[index] + step], zero > 0)
            part = np.flatnonzero(length < window)
            for index, begin, size, sequence, offset, cut in rows.place(length[part], rank[part]):
                index = part[index]
                yield made(index, n[index] - length[index] + begin, size, wholes + sequence, offset, flat[first_crc[index]], cut)

    # The placed pieces are written: both kinds read them, and ranks are not worked out twice.
    placed = stage(ranked.mapInArrow(run, schema), "pieces")
    cut = placed.filter("cut").drop("ids_crc32").join(tokens.select("at", "ids", F.col("n").alias("ids_n")), "at")
    final = placed.filter("not cut")
    columns = final.columns

    def sums(batches):
        for batch in sliced(batches):
            get = {k: batch.column(k) for k in batch.schema.names}
            crc = []
            for raw, n, start, size in zip(*(get[k].to_pylist() for k in ("ids", "ids_n", "start", "length")), strict=True):
                width = len(raw) // n
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{width}")[start:start + size].astype("<u4")))
            get["ids_crc32"] = pa.array(crc, pa.int64())
            yield pa.RecordBatch.from_arrays([get[k] for k in columns], names=columns)

    return final.unionAll(cut.mapInArrow(sums, final.schema))
