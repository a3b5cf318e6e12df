from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.core.types import SchemaError
from tablewright.operators import charts, custom, text
from tablewright.plans.compose import Flow, insight_summary
from tablewright.sources import sinks, tables


def test_cut_word_keeps_nulls_and_drops_marks(spark):
    df = spark.createDataFrame([(1, "Rate: 3.5% of v2, ok?"), (2, ""), (3, None), (4, "天气好,a")], "id int, t string")
    got = {r.id: r.seg_result for r in text.cut_word(df, "t").collect()}
    assert got == {1: "Rate、3.5%、of、v2、ok", 2: None, 3: None, 4: "天、气、好、a"}


def test_dictionary_segmentation(spark):
    words = {"天气": 10.0, "天气预报": 5.0, "预报": 4.0, "今天": 8.0}
    df = spark.createDataFrame([(1, "今天天气预报 ok 3.5%"), (2, None)], "id int, t string")
    got = {r.id: r.seg_result for r in text.cut_word(df, "t", words).collect()}
    assert got == {1: "今天、天气预报、ok、3.5%", 2: None}


def test_word_count_links_children(spark):
    df = spark.createDataFrame([(7, "b a b"), (8, None)], "id int, t string")
    rows = text.word_count(df, "id", "t").collect()
    assert {(r.node_id, r.parent_id, r.id, r.tag_result, r.word_count) for r in rows} == {
        ("7", None, 7, None, None), ("8", None, 8, None, None), ("7/a", "7", None, "a", 1), ("7/b", "7", None, "b", 2)}


def test_keywords_with_given_idf(spark):
    df = spark.createDataFrame([(1, "apple pear pear the kiwi x"), (2, None), (3, "the")], "id int, t string")
    idf = spark.createDataFrame([("apple", 9.0), ("pear", 2.0), ("fig", 1.0)], "word string, idf double")
    got = {r.id: r.tag_result for r in text.word_tag(df, "id", "t", 2, idf=idf).collect()}
    assert got == {1: "apple、pear", 2: None, 3: ""}


def test_box_equals_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(np.round(v, 1))) for v in rng.normal(size=90)] + [("x", 1.0), ("y", 2.0), ("y", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in charts.chart_box(df, "g", "v", "aggregate").collect():
        vals = [v for g, v in rows if g == r.g]
        assert (r.low, r.q1, r.median, r.q3, r.high) == pytest.approx(tuple(np.percentile(vals, [0, 25, 50, 75, 100])))


def test_box_of_odd_values(spark):
    """Far outliers, infinities, equal values, tiny values, missing values, null groups and a table without groups."""
    rng = np.random.default_rng(7)
    groups = {"wide": np.concatenate([rng.normal(size=400), [1e300, -1e300, 1.7e308, -1.7e308]]), "power": 10.0 ** rng.uniform(-300, 300, 500),
              "same": np.full(50, 3.25), "tiny": rng.integers(0, 5, 60) * 5e-324, "ends": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]), None: rng.normal(size=77)}
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals] + [("same", None), ("same", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: tuple(r)[1:] for r in charts.chart_box(df, "g", "v", "aggregate").collect()}
    assert set(got) == set(groups)

    def plain(vals):
        vals, out = sorted(float(v) for v in vals), []
        for q in charts.QUARTILES:
            at = (len(vals) - 1) * q
            low, high = vals[math.floor(at)], vals[math.ceil(at)]
            out.append(low + (high - low) * (at - math.floor(at)) if low != high else low)
        return out

    for g, vals in groups.items():
        for mine, want in zip(got[g], plain(vals), strict=True):
            assert mine == want or (math.isinf(want) and not math.isfinite(mine)) or mine == pytest.approx(want, rel=1e-12, abs=0)
    whole = charts.chart_box(df.where("g is null"), None, "v", "aggregate").first()
    assert tuple(whole) == pytest.approx(plain(groups[None]))
    assert charts.chart_box(df.where("false"), "g", "v", "aggregate").count() == 0


def test_deep_trees(spark):
    """A path of a thousand nodes, a star, values that are missing, and a node that is its own parent."""
    path = [(i, i - 1 if i else None, float(i)) for i in range(1_000)]
    star = [(5_000, None, None)] + [(5_001 + i, 5_000, 1.0 if i else None) for i in range(300)]
    df = spark.createDataFrame(path + star + [(9_000, 8_999, 2.0)], "id long, pid long, v double").withColumn("n", F.col("id"))
    out = {r.id: r.subtree_total for r in charts.chart_tree(df, "id", "pid", "n", "v", "aggregate").collect()}
    assert all(out[i] == sum(range(i, 1_000)) for i in range(1_000)) and out[5_000] == 299 and out[5_001] is None and out[9_000] == 2
    own = spark.createDataFrame([(1, 1, 1.0), (2, None, 1.0)], "id long, pid long, v double").withColumn("n", F.col("id"))
    with pytest.raises(ValueError, match="cycle"):
        charts.chart_tree(own, "id", "pid", "n", "v", "aggregate")


def test_tree_totals_and_cycles(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "a", 2.0), ("c", "b", 3.0), ("d", "a", 4.0)], "id string, pid string, v double")
    out = {r.id: r.subtree_total for r in charts.chart_tree(df.withColumn("n", F.col("id")), "id", "pid", "n", "v", "aggregate").collect()}
    assert out == {"a": 10.0, "b": 5.0, "c": 3.0, "d": 4.0}
    loop = spark.createDataFrame([("a", "b", "a", 1.0), ("b", "a", "b", 1.0)], "id string, pid string, n string, v double")
    with pytest.raises(ValueError):
        charts.chart_tree(loop, "id", "pid", "n", "v", "aggregate")


def test_charts_check_columns(spark):
    df = spark.range(3)
    with pytest.raises(SchemaError):
        charts.chart_line(df, "id", "nope")
    with pytest.raises(ValueError):
        charts.chart_line(df, "id", "id", mode="sideways")


def test_keyed_edits(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 3.0)], "k int, s string, v double")
    change = spark.createDataFrame([(2, None), (None, "z"), (9, "new")], "k int, s string")
    assert {tuple(r) for r in sinks.update_by_key(base, change, "k").collect()} == {(1, "a", 1.0), (2, None, 2.0), (None, "z", 3.0)}
    assert {tuple(r) for r in sinks.upsert(base, change, "k").collect()} == {
        (1, "a", 1.0), (2, None, 2.0), (None, "z", 3.0), (9, "new", None)}
    assert {r.k for r in sinks.delete_by_key(base, change, "k").collect()} == {1}
    with pytest.raises(SchemaError):
        sinks.update_by_key(base, change.withColumn("other", F.lit(1)), "k")
    with pytest.raises(SchemaError):
        sinks.add_column(base, "s", "NUMBER")


def test_managed_tables(spark):
    made = sinks.create_table(spark, [(1.0, "x")], [("n", "NUMBER"), ("s", "VARCHAR2")], "tw_test_made")
    assert made.columns == ["n", "s", "load_ts"]
    sinks.append(spark.createDataFrame([(2.0, "y")], "n double, s string"), "tw_test_made")
    sinks.append_mapped(spark.createDataFrame([(5, "z")], "num int, drop string"), "tw_test_made", [("num", "n")])
    rows = spark.table("tw_test_made").orderBy("n").collect()
    assert [(r.n, r.s, r.load_ts is not None) for r in rows] == [(1.0, "x", True), (2.0, "y", True), (5.0, None, False)]
    with pytest.raises(SchemaError):
        sinks.append_mapped(spark.range(1), "tw_test_made", [("id", "nope")])
    with pytest.raises(SchemaError):
        sinks.append_mapped(spark.range(1), "tw_test_made", [("nope", "n")])
    assert "tw_test_made" in {r.name for r in tables.describe_tables(spark, "test_made").collect()}
    spark.sql("DROP TABLE tw_test_made")


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1.5,x\n,NaT\nNaN,\ninf,q\n")
    df = tables.read_table(spark, "csv", str(path), schema="a double, b string")
    assert [(r.a, r.b) for r in df.collect()] == [(1.5, "x"), (None, None), (None, None), (float("inf"), "q")]
    path.write_text("a,b\noops,x\n")
    with pytest.raises(Exception):
        tables.read_table(spark, "csv", str(path), schema="a double, b string").collect()


def test_checkpoint_reads_back(spark, tmp_path):
    df = sinks.checkpoint(spark.range(5), str(tmp_path / "node"))
    assert df.count() == 5 and "node" in df.inputFiles()[0]


def test_flows(spark):
    touched = []

    def both(left, right=None):
        touched.append(1)
        return {"doubled": left.selectExpr("id * 2 AS id"), "size": right}

    flow = Flow(both)
    assert flow.inputs == ["left", "right"]
    assert flow.run_to("doubled", left=spark.range(3)).count() == 3
    assert Flow(lambda x: flow.run_in_order(x), "outer").run(x=spark.range(2))["doubled"].count() == 2
    assert flow.publish("tw_", left=spark.range(4))["size"] is None and spark.table("tw_doubled").count() == 4
    with pytest.raises(TypeError):
        flow.run(other=1)
    with pytest.raises(TypeError):
        Flow(lambda: 3).run()


def test_insight_summary(spark):
    df = spark.createDataFrame([(1, None), (4, "b")], "n int, s string")
    assert [tuple(r) for r in insight_summary(df).collect()] == [("n", 2, 0, "1", "4"), ("s", 2, 1, "b", "b")]


def test_custom_functions(spark):
    custom.register("count_rows", lambda df, plus=0: df.count() + plus)
    assert custom.apply_custom("count_rows", spark.range(3), plus=1) == 4 and "count_rows" in custom.registered()
    with pytest.raises(KeyError):
        custom.apply_custom("nothing", spark.range(1))
    with pytest.raises(TypeError):
        custom.register("text", "print(1)")


def test_fit_per_group_any_size(spark):
    df = spark.range(5_000).selectExpr("id", "if(id % 3 = 0, null, id % 3) g").repartition(7)
    out = custom.fit_per_group(df, "g", lambda pdf: pdf["id"].sum(), lambda a, b: a + b,
                               lambda key, state: {"g": key[0], "total": int(state)}, "g long, total long", fan_in=2).collect()
    want = {g: sum(i for i in range(5_000) if (i % 3 or None) == g) for g in (None, 1, 2)}
    assert {r.g: r.total for r in out} == want


def test_scatter_bins(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.1, 0.2), (float("nan"), 1.0), (None, 2.0)], "x double, y double")
    rows = charts.chart_scatter(df, "x", "y", "aggregate", 2).collect()
    assert {(r.x_low, r.y_low): r.n for r in rows} == {(0.0, 0.0): 2, (0.5, 0.5): 1}


def test_parts_grow_with_the_texts(spark, monkeypatch):
    """More text gives more parts, so that the words which one task counts do not grow; the counts stay the same."""
    df = spark.createDataFrame([(i, f"alpha beta {i} alpha") for i in range(400)] + [(7, "alpha gamma"), (None, "beta")], "id long, text string")
    want = sorted(map(tuple, text.token_counts(df, "id", "text").collect()), key=str)
    tags = sorted(map(tuple, text.word_tag(df, "id", "text", 2).collect()), key=str)
    monkeypatch.setattr(text, "PART_CHARACTERS", 100, raising=False)
    counts = text.token_counts(df, "id", "text")
    assert counts.select(F.spark_partition_id()).distinct().count() > 16
    assert sorted(map(tuple, counts.collect()), key=str) == want
    assert sorted(map(tuple, text.word_tag(df, "id", "text", 2).collect()), key=str) == tags
