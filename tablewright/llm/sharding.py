"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into buckets; how many rows each bucket sends to each shard is drawn exactly
as a uniform shuffle would deal them (a multivariate hypergeometric draw whose rows sum to
the bucket sizes and whose columns sum to the shard sizes). Each bucket is permuted and cut
at its counts, the rows are exchanged, and each shard is permuted again. All work on rows is
DataFrame functions; the driver draws one number a bucket and shard, at most
``20_000 x shards`` whatever the table.

Randomness is a hash of the seed and of the row's number in a written table, so a lost
executor's part comes out the same again.

Defined results: a null text has no bytes; repeated rows each get a slot of their own; shard
sizes differ by at most one row, the first shards take the extra rows; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.shared import stage

BUCKET_ROWS = 4_096
MOST_BUCKETS = 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, for counts of any size.

    Inversion over the values within 14 standard deviations of the mode.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = int(14 * (draws * (good / total) * (bad / total) * max(0.0, (total - draws) / max(1, total - 1))) ** 0.5) + 40
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    cumulative = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(cumulative, rng.random() * cumulative[-1], "right"))


def matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each bucket sends to each shard."""
    rng, rows = np.random.default_rng(seed), sum(sizes)
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for i, size in enumerate(sizes):
        left, rest = size, sum(room)
        for s in range(shards):
            rest -= room[s]
            out[i, s] = hypergeometric(rng, room[s], rest, left) if left else 0
            left -= out[i, s]
        room = [r - int(x) for r, x in zip(room, out[i], strict=True)]
    return out


def assign(docs: DataFrame, shards: int = 24, seed: int = 20_011, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the carried columns), ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = stage(docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
                             F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("at")), "rows")
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(buckets)).cast("int"))
    sizes = [0] * buckets
    for r in dealt.groupBy("bucket").count().collect():  # one row a bucket
        sizes[r["bucket"]] = r["count"]
    cuts = np.cumsum(matrix(sizes, shards, seed), axis=1).tolist()
    bounds = docs.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cuts)], "bucket int, bounds array<bigint>")
    local = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "at"), "at")
    sent = (dealt.withColumn("place", F.row_number().over(local)).join(F.broadcast(bounds), "bucket")
            .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("place")))))
    parts = max(1, min(MOST_BUCKETS // shards, -(-n // shards // BUCKET_ROWS)))
    sent = stage(sent.select("row", "size", "text_crc32", "at", "shard", F.pmod(F.xxhash64(F.lit(seed + 2), "at"), F.lit(parts)).cast("int").alias("part")), "sent")
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("here")).select(  # at most 20,000 rows
        "shard", "part", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("begin"))
    again = Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit(seed + 3), "at"), "at")
    return (sent.withColumn("place", F.row_number().over(again)).join(F.broadcast(begins), ["shard", "part"])
            .select("row", "size", "text_crc32", "shard", (F.col("begin") + F.col("place") - 1).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 20_011, rows_a_file: int = 1_000_000) -> None:
    """Write whole rows as one folder a shard, in slot order inside each file."""
    placed = assign(docs, shards, seed, tuple(docs.columns))
    file = F.floor(F.col("slot") / rows_a_file)
    (placed.repartition("shard", file).sortWithinPartitions("shard", "slot").select("row", "shard", "slot")
     .write.partitionBy("shard").parquet(path))
