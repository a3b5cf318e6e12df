from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from tablewright.core.layout import lagged, row_index, running_sum
from tests.conftest import SMALL


def skewed(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    # one series holds well over a third of the rows
    return e.withColumn("series", F.when(F.col("event_id") % 5 < 3, "hot").otherwise(F.col("event_type")))


@pytest.mark.parametrize("by", [None, "series"])
def test_long_series_equal_plain_windows(spark, by):
    df = skewed(spark)
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    want = {r.event_id: (r.i, round(r.s, 6)) for r in df.select(
        "event_id", F.row_number().over(w).alias("i"),
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    out = row_index(df, ["ts", "event_id"], by=by, name="i")
    out = running_sum(out, {"s": "value"}, ["ts", "event_id"], by=by)
    got = {r.event_id: (r.i, round(r.s, 6)) for r in out.collect()}
    assert got == want


def test_order_may_fall(spark):
    df = skewed(spark)
    out = row_index(df, [F.col("value").desc(), F.col("event_id")], name="i")
    rows = sorted((r.i, -r.value, r.event_id) for r in out.collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("block", [3, 17, 10_000])
def test_lags_cross_blocks(spark, block):
    df = row_index(skewed(spark), ["ts", "event_id"], by="series", name="i")
    w = Window.partitionBy("series").orderBy("i")
    want = {r.event_id: (r.a, r.b) for r in df.select(
        "event_id", F.lag("value", 1).over(w).alias("a"), F.lag("value", 2).over(w).alias("b")).collect()}
    out = lagged(df, ["value"], 2, "i", by="series", block=block)
    got = {r.event_id: (r.value_lag1, r.value_lag2) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize("parts", ["1", "37"])
def test_any_number_of_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(500).selectExpr("id", "if(id < 400, null, id % 7) g", "if(id % 10 = 0, null, 1.0) v", "0 tie")
        out = running_sum(row_index(df, "tie", by="g", name="i"), {"s": "v"}, "i", by="g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in {r.g for r in out}:
        own = sorted(((r.i, r.v, r.s) for r in out if r.g == g), key=lambda r: r[0])
        assert [r[0] for r in own] == list(range(1, len(own) + 1))
        total = None
        for _, v, s in own:
            total = v if total is None else total + (v or 0)
            assert s == total


def test_empty(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert row_index(df, "v", by="g").count() == 0 and running_sum(df, {"s": "v"}, "v").count() == 0
