from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.core.types import SchemaError
from tablewright.sources import paging, tables


def scanned(df):
    """Rows and files that the scan of a computed DataFrame has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    while not plan.getClass().getSimpleName().startswith("FileSourceScan"):
        kids = plan.children()
        plan = kids.apply(0) if kids.size() else plan.plan()
    return [plan.metrics().apply(m).value() for m in ("numOutputRows", "numFiles")]


def test_a_deep_page_reads_one_part(spark, tmp_path):
    df = spark.range(100_000).selectExpr("id", "id % 97 v", "repeat(string(id), 5) s")
    order = [F.col("v").desc(), F.col("id")]
    copy = paging.paged(df, order, str(tmp_path / "p"), parts=20)
    assert copy.total == 100_000 and len(copy.parts) == 20
    for page, size in ((1, 10), (1000, 10), (7_777, 10), (10_000, 10), (3, 30_000), (10_001, 10)):
        want = [tuple(r) for r in tables.page(df, order, page, size).collect()]
        assert [tuple(r) for r in copy.page(spark, page, size).collect()] == want
    rows, files = scanned(copy.page(spark, 1000, 10))
    assert files <= 2 and rows <= 2 * max(n for _, _, n in copy.parts)
    again = paging.open_paged(spark, str(tmp_path / "p"))
    assert again == copy
    assert again.page_with_total(spark, 5, 10).first().total == 100_000


def test_ties_nulls_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, "c"), (None, None)] * 40, "k int, s string")
    copy = paging.paged(df, "k", str(tmp_path / "t"), parts=4)
    got = [r for p in range(1, 30) for r in copy.page(spark, p, 7).collect()]
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    assert [r.k for r in got] == [None] * 80 + [1] * 120
    empty = paging.paged(df.where("false"), "k", str(tmp_path / "e"))
    assert empty.total == 0 and empty.page(spark, 1, 5).count() == 0 and empty.page(spark).columns == ["k", "s"]
    with pytest.raises(ValueError):
        copy.page(spark, 0, 5)
    with pytest.raises(SchemaError):
        paging.paged(df.withColumn("_pos", F.lit(1)), "k", str(tmp_path / "x"))
