"""Exact deduplication by a heavy-hitter split.

Texts are equal when identical after every run of white space became one space. Their
digests are written once; Misra-Gries summaries of the digests, one a partition, are added
up to find every digest that may hold more than ``share`` of the rows; those are counted
exactly, and the true ones are broadcast (at most ``1 / share`` rows), so that their copies
are settled where they lie. All other digests have small groups and use an ordinary shuffle.

Defined results: a null text counts as empty; of equal texts the row with the smallest
``doc_id`` stays, null ids last; of rows that repeat it exactly one stays.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.shared import stage, wrapped

SHARE = 1 / 2_000


def normalised(text) -> F.Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def misra_gries(df: DataFrame, column: str, counters: int) -> DataFrame:
    """Summed Misra-Gries counts of a binary column: ``item, low``.

    Each partition keeps ``counters`` counters. A summed count is at most the true count and
    short of it by at most rows / (counters + 1).
    """
    def run(batches):
        kept: dict = {}
        for batch in batches:
            for item, n in _counted(batch.column(0)):
                kept[item] = kept.get(item, 0) + n
            if len(kept) > 8 * counters:
                kept = _reduced(kept, counters)
        kept = _reduced(kept, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["item", "low"])

    return df.select(column).mapInArrow(run, "item binary, low bigint").groupBy("item").agg(F.sum("low").alias("low"))


def _counted(column: pa.Array):
    for x in column.value_counts():
        if x["values"].is_valid:
            yield x["values"].as_py(), x["counts"].as_py()


def _reduced(kept: dict, counters: int) -> dict:
    """Take the next largest count from all of the ``counters`` largest, as merging summaries does."""
    if len(kept) <= counters:
        return kept
    cut = sorted(kept.values(), reverse=True)[counters]
    return {k: n - cut for k, n in kept.items() if n > cut}


def heavy(digests: DataFrame, share: float = SHARE) -> DataFrame:
    """Verified frequent digests: ``digest, keep_id, keep_at, group_size``; at most 1 / share rows."""
    rows = digests.count()
    low = misra_gries(digests, "digest", int(2 / share))
    # The summed counts come to no more than all rows, so at most 2 / share digests reach half a share.
    maybe = low.filter(F.col("low") >= F.lit(rows * share / 2)).select(F.col("item").alias("digest"))
    found = digests.join(F.broadcast(maybe), "digest").groupBy("digest").agg(
        F.min(_first()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return found.filter(F.col("group_size") >= F.lit(rows * share)).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size")


def _first() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id"), F.col("at").alias("at"))


def dedup(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests = stage(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
                                F.monotonically_increasing_id().alias("at")), "digests")
    winners = stage(heavy(digests, share), "frequent")
    settled = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    best = F.min(_first()).over(group)
    rest = (rest.withColumn("best", best).withColumn("group_size", F.count(F.lit(1)).over(group))
            .select("digest", "doc_id", "at", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size"))
    both = settled.select(*rest.columns).unionAll(rest)
    return both.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Copies of frequent texts are removed before the shuffle; what is left (the winners and
    all other texts) is put together by digest, and the first row of each group stays.
    """
    digest = F.unhex(F.sha2(normalised(docs["text"]).cast("binary"), 256))
    narrow = stage(docs.select(docs["doc_id"].alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("at")), "digests")
    winners = stage(heavy(narrow, share), "frequent").select(F.col("digest").alias("frequent"), "keep_id")
    rows = wrapped(docs, digest=digest).join(F.broadcast(winners), F.col("digest") == F.col("frequent"), "left")
    rows = rows.filter(F.col("frequent").isNull() | F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    order = Window.partitionBy("digest").orderBy(F.col("row.doc_id").asc_nulls_last())
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row.*")
