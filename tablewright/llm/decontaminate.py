"""Benchmark decontamination: size-partitioned MinHash containment search.

A document holds a test item when at least ``threshold`` of the item's distinct word
shingles occur in it. An item's sketch is the bottom of its shingles by hash (a bottom-k
MinHash): as many as may be missing, and one more, so at least one of them occurs in every
document that holds the item. Items are partitioned by size, each partition with its own
sketches, and a document is searched only in the partitions whose items it is long enough
to hold. Candidates are verified by exact shingle containment in the same task. Items go
out in blocks of bounded size, one pass over the documents each; documents never shuffle.

Words are what lies between ASCII white space and punctuation, A-Z lower-cased. An item of
fewer words than a shingle is one shingle of its own length.

Defined results: null and empty texts hold nothing and as items match nothing; repeated
items each match; repeated documents each are reported; a null document id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.shared import sliced

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 300_000
_TOP = 18


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def shingles(words: list[bytes], size: int) -> set[bytes]:
    """Distinct shingles as bytes; a shorter text is one shingle."""
    n = min(size, len(words))
    return {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Hasher:
    """Shingle hashes of whole texts; a word is hashed once."""

    def __init__(self):
        self.known = _WordHashes()

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def shingles(h: np.ndarray, size: int) -> np.ndarray:
        """Hash of each shingle, repeats included, from the hashes of the words."""
        n = max(0, len(h) - size + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                out ^= h[j:j + n]
                out *= _STEP
            out ^= out >> np.uint64(32)
            out *= _STEP
        return out


def sketch_size(shingle_count: int, threshold: float) -> int:
    """One more than the shingles that may be missing."""
    return shingle_count - needed(shingle_count, threshold) + 1


def needed(shingle_count: int, threshold: float) -> int:
    return max(1, int(np.ceil(threshold * shingle_count - 1e-9)))


class Block:
    """Items of one broadcast: texts, and for each shingle length and size partition the sketches."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, threshold: float):
        self.threshold, hasher = threshold, Hasher()
        self.items = []  # (item_id, shingle length, shingles, needed)
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            own, n = shingles(words, size), min(size, len(words))
            k, need = len(self.items), needed(len(own), threshold)
            self.items.append((item_id, n, own, need))
            hashes = np.unique(hasher.shingles(hasher.words(words), n))
            for h in hashes[: max(1, sketch_size(len(own), threshold))].tolist():
                parts.setdefault((n, need.bit_length()), []).append((h, k))
        self.parts, self.seen = [], {}
        for (n, bits), rows in sorted(parts.items()):
            rows.sort()
            sketch = np.array([r[0] for r in rows], np.uint64)
            self.parts.append((n, 1 << (bits - 1), sketch, np.array([r[1] for r in rows])))
            self.seen.setdefault(n, np.zeros(1 << _TOP, bool))[sketch >> np.uint64(64 - _TOP)] = True

    def search(self, words: list[bytes], hasher: Hasher) -> Iterator[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles) of the items that a text of these words holds."""
        hashed: dict[int, np.ndarray] = {}
        maybe: set[int] = set()
        by_word = hasher.words(words)
        for n, least, sketch, item in self.parts:
            if len(words) - n + 1 < least:
                continue  # too short for any item of this partition
            if n not in hashed:  # the shingles whose leading bits some sketch has
                h = hasher.shingles(by_word, n)
                hashed[n] = np.unique(h[self.seen[n][h >> np.uint64(64 - _TOP)]])
            own = hashed[n]
            if len(own):
                low, high = np.searchsorted(sketch, own), np.searchsorted(sketch, own, "right")
                for a, b in zip(low[low < high], high[low < high], strict=True):
                    maybe.update(item[a:b].tolist())
        texts: dict[int, set[bytes]] = {}
        for k in sorted(maybe):
            item_id, n, own, need = self.items[k]
            if n not in texts:
                texts[n] = shingles(words, n)
            shared = len(own & texts[n])
            if shared >= need:
                yield item_id, shared, len(own)


def blocks(items: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most ``block_bytes`` of text (one item at least), read one after the other."""
    block, held = [], 0
    for r in items.select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).toLocalIterator():
        if block and held + len(r["text"]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["item_id"], bytes(r["text"])))
        held += len(r["text"])
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """Pairs ``doc_id, item_id, shared, item_shingles``: the document holds the item."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()),
                           T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = None
    for block in blocks(items, block_bytes):
        found = texts.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), size, threshold, schema), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _search(block, size: int, threshold: float, schema: T.StructType):
    def run(batches):
        index, hasher = Block(block.value, size, threshold), Hasher()
        for batch in sliced(batches):
            at, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for hit in index.search(words_of(text), hasher):
                    at.append(k)
                    found.append(hit)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            cols = [pa.array([f[c] for f in found], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=schema.names)

    return run


def keep_uncontaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were; one map-side pass a block."""
    at = docs.columns.index("text")
    spark = docs.sparkSession

    def kept(block):
        def run(batches):
            index, hasher = Block(block.value, size, threshold), Hasher()
            for batch in sliced(batches):
                clean = [next(index.search(words_of(t), hasher), None) is None for t in batch.column(at).cast(pa.binary()).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in blocks(items, block_bytes):
        docs = docs.mapInArrow(kept(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
