"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into segments, and the bit counts of the segments are a point of an
integer grid. The Manhattan distance of two points is never more than the number of
differing bits, so every link joins two points at most two grid steps apart, and such points
have a grid cell in common that is at most one step from either. Each distinct fingerprint
is therefore entered in its own cell and in the neighbouring ones; cells are joined, and
candidates are verified by their bits. Cells with more than ``crowd`` members would give
all pairs of them: their members are verified through the fingerprints one bit away
instead, of which two linked fingerprints always share one (at most 65 members a group).

Defined results: null and empty texts have fingerprint zero, linked like any other; a
component's id is the smallest doc_id in it, null ids aside (null when it has no other);
rows that repeat an id count as linked through it only by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.components import components
from tablewright.llm.shared import merged, sliced, stage, wrapped

SEGMENTS = 16
CROWD = 8
SENT = 10_000_000  # bytes of removed ids that are broadcast
_ROW = 64  # bytes that a broadcast row takes besides its id
_BLOCK = 32_768


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - size) + 1
    first, end = begins[:last].tolist(), ends[min(size, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for s in range(0, last, _BLOCK):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(first[s:s + _BLOCK], end[s:s + _BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` (the bits as a signed long) of every row."""
    def run(batches):
        for batch in sliced(batches):
            fps = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("doc_id", ids), T.StructField("fp", T.LongType())]))


def cells_of(fps: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (index of a fingerprint, cell): its own grid cell and those one step away.

    A cell's number is the sum of count times a power of (segment width + 1), wrapped to 64
    bits; with 16 segments it does not wrap.
    """
    width = 64 // segments
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(len(fps), segments, width).sum(axis=2, dtype=np.int64)
    powers = np.array([pow(width + 1, k, 1 << 64) for k in range(segments)], np.uint64).view(np.int64)
    with np.errstate(over="ignore"):
        own = counts @ powers
        up_i, up_s = np.nonzero(counts < width)
        down_i, down_s = np.nonzero(counts > 0)
        index = np.concatenate([np.arange(len(fps)), up_i, down_i])
        cell = np.concatenate([own, own[up_i] + powers[up_s], own[down_i] - powers[down_s]])
    return index, cell


def entered(distinct: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``cell, fp``: every distinct fingerprint in its own grid cell and the neighbouring ones."""
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            index, cell = cells_of(fps.view(np.uint64), segments)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[index])], names=["cell", "fp"])

    return distinct.select("fp").mapInArrow(run, "cell bigint, fp bigint")


def links(distinct: DataFrame, max_bits: int = 2, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Pairs ``u, v`` of distinct fingerprints that connect all that differ in at most ``max_bits`` bits."""
    if max_bits != 2:
        raise ValueError("cells one grid step around each fingerprint meet for two bits")
    grid = entered(distinct, segments)
    shared = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(grid.join(merged(shared), "cell"), "cells")
    few = members.filter(F.col("n") <= crowd)
    pairs = (few.select("cell", F.col("fp").alias("u")).join(merged(few.select("cell", F.col("fp").alias("v"))), "cell")
             .filter((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v").distinct())
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = (members.filter(F.col("n") > crowd).select("fp").distinct()
            .select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")))
    hubs = near.groupBy("near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("near", "v")
    crowded = near.join(merged(hubs), "near").filter("fp != v").select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v")).distinct()
    return pairs.unionAll(crowded)


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    rows = stage(fingerprints(docs, size), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stage(components(links(distinct, max_bits, segments, crowd)), "roots")
    class_of = distinct.join(merged(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = class_of.join(merged(smallest), "root").select("fp", "component_id")
    return rows.join(merged(named), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows without an id stay."""
    found = near_duplicates(docs, size, max_bits)
    # Written first: the ids' true size decides the join, and the rows with their texts move only where they are many.
    gone = stage(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    size = gone.agg(F.sum(F.octet_length(F.col("gone").cast("string")) + _ROW)).first()[0] or 0
    return wrapped(docs).join(F.broadcast(gone) if size <= SENT else merged(gone), F.col("row")["doc_id"] == F.col("gone"), "left_anti").select("row.*")
