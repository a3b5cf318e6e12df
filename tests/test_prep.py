from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.core.gram import moments
from tablewright.operators import prep
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def test_scaling_round_trip(lines):
    cols = ["l_quantity", "l_extendedprice"]
    scaled, scaler = prep.min_max_scale(lines, cols)
    r = scaled.agg(F.min("l_quantity"), F.max("l_extendedprice")).first()
    assert tuple(r) == (0.0, 1.0)
    back = prep.inverse_min_max(scaled, cols, scaler).toPandas()
    want = lines.toPandas()
    assert np.allclose(np.sort(back["l_extendedprice"]), np.sort(want["l_extendedprice"]), rtol=1e-5)


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, "y")], "a double, b double, c string")
    out, scaler = prep.min_max_scale(df, ["a", "b"], {"a": (2.0, 4.0)})
    assert [(r.a, r.b) for r in out.collect()] == [(-0.5, 5.0), (0.5, 5.0)]  # constant unchanged, no clipping
    assert scaler == {"a": (2.0, 4.0), "b": (5.0, 5.0)}
    renamed = out.withColumnRenamed("a", "prediction")
    assert [r.prediction for r in prep.inverse_min_max(renamed, ["prediction", "b"], scaler).collect()] == [1.0, 3.0]
    with pytest.raises(ValueError):
        prep.inverse_min_max(out, ["a"], scaler)
    with pytest.raises(ValueError):
        prep.min_max_scale(df, ["c"])
    with pytest.raises(ValueError):
        prep.min_max_scale(df, ["a"], {"a": (None, 4.0)})


def test_natural_log_edges(spark):
    df = spark.createDataFrame([(math.e,), (0.0,), (-1.0,), (None,)], "a double")
    v = [r.a for r in prep.column_process(df, {"a": "nplog"})[0].collect()]
    assert v[0] == pytest.approx(1.0) and v[1] == -math.inf and math.isnan(v[2]) and v[3] is None


@pytest.mark.parametrize("power", [0.0, 0.5, -1.0, 2.0])
def test_boxcox_lambda_is_the_maximum(spark, power):
    rng = np.random.default_rng(5)
    z = 10 + rng.normal(size=800)
    x = np.exp(z / 5) if power == 0 else z ** (1 / power)
    lam = prep.boxcox_lambda(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")

    def llf(p):
        y = np.log(x) if p == 0 else (x**p - 1) / p
        return (p - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    near = [llf(lam + d) for d in (-1e-3, 0.0, 1e-3)]
    assert near[1] >= max(near[0], near[2])
    grid = np.linspace(-6, 6, 241)
    assert near[1] >= max(llf(g) for g in grid if g != 0) - 1e-6


def test_boxcox_refuses_bad_input(spark):
    for rows in ([(1.0,), (0.0,)], [(2.0,), (2.0,)]):
        with pytest.raises(ValueError):
            prep.boxcox_lambda(spark.createDataFrame(rows, "x double"), "x")


def test_polynomial_names_and_values(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    out = prep.polynomial(df, degree=2)
    assert out.columns == ["a", "b", "c", "a^2", "a b", "a c", "b^2", "b c", "c^2"]
    assert list(out.first()) == [2, 3, 5, 4, 6, 10, 9, 15, 25]
    assert prep.polynomial(df, degree=3, interaction_only=True).columns[-1] == "a b c"
    assert prep.polynomial(df, ["a"], degree=3).columns == ["b", "c", "a", "a^2", "a^3"]


def test_moments_both_ways(spark, lines):
    x = lines.toPandas().to_numpy()
    m = moments(lines, lines.columns)
    assert m.n == len(x) and np.allclose(m.cross / m.n, np.cov(x.T, ddof=0)) and np.allclose(m.mean, x.mean(axis=0))
    wide = lines.select(*[(F.col(c) * k + k).alias(f"{c}_{k}") for c in lines.columns for k in (1, 2, 3, 4)])
    w = moments(wide, wide.columns)  # more columns than one aggregate takes
    assert np.allclose(w.cross / w.n, np.cov(wide.toPandas().to_numpy().T, ddof=0), rtol=1e-9)


def test_moments_merge(lines):
    a, b = moments(lines.where("l_tax > 0.04"), lines.columns), moments(lines.where("l_tax <= 0.04"), lines.columns)
    whole = moments(lines, lines.columns)
    assert np.allclose(a.merge(b).cross, whole.cross)


def test_pca_matches_numpy(lines):
    x = lines.toPandas().to_numpy()[:, :3]
    out = prep.pca_project(lines, lines.columns[:3], ["l_tax"], 2)
    assert out.columns == ["x_1", "x_2", "l_tax"]
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    got = out.toPandas().to_numpy()[:, :2]
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-5)


@pytest.mark.parametrize("exact", [False, True])
def test_split_is_a_partition(spark, exact):
    o = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey")
    parts = prep.data_split(o, "o_orderkey", 60, 15, 25, seed=9, exact=exact)
    n = {k: v.count() for k, v in parts.items()}
    assert sum(n.values()) == o.count()
    union = parts["train"].union(parts["test"]).union(parts["valid"])
    assert union.distinct().count() == o.count()
    if exact:
        assert n == {"train": 900, "test": 225, "valid": 375}
    else:
        assert abs(n["train"] - 900) < 80


def test_exact_split_of_repeated_keys_and_rows(spark):
    """A key with a third of the rows, and rows that are equal throughout, are cut in the middle."""
    rows = [(i, f"r{i}") for i in range(200)] + [(7, f"s{i}") for i in range(90)] + [(8, "same")] * 110
    df = spark.createDataFrame(rows, "k long, v string").repartition(6)
    for shares, want in (((60, 15, 25), (240, 60, 100)), ((34, 33, 33), (136, 132, 132)), ((1, 98, 1), (4, 392, 4)), ((0, 50, 50), (0, 200, 200))):
        for seed in range(3):
            parts = prep.data_split(df, "k", *shares, seed=seed, exact=True)
            got = {n: [tuple(r) for r in p.collect()] for n, p in parts.items()}
            assert tuple(len(got[n]) for n in ("train", "test", "valid")) == want
            assert sorted(sum(got.values(), [])) == sorted(rows)
    two = prep.data_split(spark.createDataFrame([("a",)] * 10, "k string"), "k", 70, 30, exact=True)
    assert (two["train"].count(), two["test"].count()) == (7, 3)
    none = prep.data_split(df.limit(0), "k", 60, 20, 20, exact=True)
    assert [p.count() for p in none.values()] == [0, 0, 0]
    assert "Sort" not in two["train"]._jdf.queryExecution().executedPlan().toString()


def test_split_rules(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        prep.data_split(df, "id", 80, 30)
    assert set(prep.data_split(df, "id")) == {"train", "test"}
    given = {"train": df, "test": df.limit(0)}
    assert prep.data_split(df, "id", override=given)["train"].count() == 10
    one = prep.data_split(df, "id", override={"train": df})
    assert set(one) == {"train", "test"} and one["test"].count() == prep.data_split(df, "id")["test"].count()


def test_min_max_skips_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert prep.fit_min_max(df, ["x"]) == {"x": (1.0, 3.0)}


def test_kpi_transpose_and_weights(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0.4), ("b", [3.0, 4.0], 0.6)], "kpiName string, value array<double>, weight double")
    rows = prep.kpi_rows(df, ["a", "b"]).orderBy("pos").collect()
    assert [(r.pos, r.a, r.b) for r in rows] == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    w = spark.createDataFrame([("a", math.inf), ("b", 60.0)], "feature string, weight_pct double")
    out = {r.kpiName: r.value for r in prep.kpi_weights(df, w).collect()}
    assert out == {"a": 0.0, "b": 60.0}
