from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest

from tablewright.core import numeric
from tablewright.operators import analyze, decision, evaluate, models
from tests.test_kendall import tau_b


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def four(spark):
    rng = np.random.default_rng(11)
    f = rng.normal(size=(200, 2))
    x = np.column_stack([f[:, 0], f[:, 0] + 0.4 * rng.normal(size=200), f[:, 1], f[:, 1] * 0.8 + 0.5 * rng.normal(size=200)])
    return x, frame(spark, x, "abcd")


def test_tails():
    assert numeric.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert numeric.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert numeric.chi2_sf(50.0, 4) == pytest.approx(3.6e-10, rel=0.05)
    assert numeric.f_ppf(0.95, 3, 10) == pytest.approx(3.708264907, abs=1e-6)
    assert numeric.f_ppf(0.975, 5, 5) == pytest.approx(7.146381, abs=1e-5)


def test_confidence_golden(spark):
    # values with mean 193.66425 and standard error 24.39940007479423
    m, se = 193.66425, 24.39940007479423
    half = se * math.sqrt(4) * math.sqrt(3) / 2
    df = frame(spark, [[m - half], [m - half], [m + half], [m + half]], ["cost"])
    rows = {round(r.ci, 2): r.value for r in analyze.ci_table(df).collect()}
    assert len(rows) == 19
    assert rows[0.05] == pytest.approx(195.19425776243776, abs=1e-9)
    assert rows[0.95] == pytest.approx(241.48619539098058, abs=1e-9)
    assert rows[0.5] == pytest.approx(m + se * NormalDist().inv_cdf(0.75))


def test_pca_tables(four):
    x, df = four
    r = np.corrcoef(x.T)
    out = analyze.pca_analyze(df, list("abcd"))
    eig = np.sort(np.linalg.eigvalsh(np.round(r, 3)))[::-1]
    assert [v.y for v in out["eigenvalue"].orderBy("x").collect()] == pytest.approx(np.round(eig, 3))
    load = out["loading_table"].toPandas().set_index("feature")
    l = load[["component_1", "component_2"]].to_numpy()
    vals, vecs = np.linalg.eigh(r)
    want = vecs[:, ::-1][:, :2] * np.sqrt(vals[::-1][:2])
    assert np.allclose(np.abs(l), np.abs(want), atol=1e-3)
    assert np.allclose(load["communality"], (want**2).sum(1), atol=1e-6)
    inv = np.linalg.inv(r)
    q = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(4, dtype=bool)
    k = out["kmo"].first()
    assert k.kmo == round((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (q[off] ** 2).sum()), 3)
    assert k.bartlett_chi2 == pytest.approx(-(199 - 13 / 6) * np.log(np.linalg.det(r)), abs=1e-3)
    assert out["liner_table"].toPandas()["weight_pct"].sum() == pytest.approx(100, abs=0.05)
    v = out["variance_table"].toPandas()
    assert v["component_eigenvalue"].notna().sum() == (eig > 1).sum() == 2


def test_factor_tables(four):
    x, df = four
    out = analyze.factor_analyze(df, list("abcd"))
    l = out["loading_table"].toPandas().set_index("feature")[["component_1", "component_2"]].to_numpy()
    assert np.all(np.sort(np.abs(l), axis=1)[:, 0] < 0.2)  # simple structure after rotation
    plain = analyze.pca_analyze(df, list("abcd"))["loading_table"].toPandas()["communality"]
    assert np.allclose(out["loading_table"].toPandas()["communality"], plain)  # rotation keeps communalities
    comp = out["component_table"].toPandas()[["component_1", "component_2"]].to_numpy()
    assert np.allclose(comp, np.linalg.inv(np.corrcoef(x.T)) @ l, atol=5e-3)
    v = out["variance_table"].toPandas().dropna()
    assert v["rotated_eigenvalue"].sum() == pytest.approx(v["unrotated_eigenvalue"].sum(), abs=5e-3)


def test_constant_column_is_refused(spark):
    with pytest.raises(ValueError):
        analyze.pca_analyze(frame(spark, [[1, 2], [1, 3], [1, 5]], "ab"), ["a", "b"])


def test_critic_and_topsis(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((40, 3)) * [10, 5, 1], 2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    std = np.round(x.std(axis=0, ddof=1), 3)
    tau = np.array([[tau_b(x[:, i], x[:, j]) if i != j else 1.0 for j in range(3)] for i in range(3)])
    conflict = np.round((1 - tau).sum(axis=1), 3)
    info = std * conflict
    got = decision.critic(df, ["a", "b", "c"], block_rows=8).toPandas()
    assert np.allclose(got["information"], info) and np.allclose(got["weight_pct"], np.round(info / info.sum() * 100, 2))
    w = x * np.round(info / info.sum(), 5)
    dp = np.sqrt(((w - w.max(0)) ** 2).sum(1))
    dm = np.sqrt(((w - w.min(0)) ** 2).sum(1))
    c = np.round(dm / (dp + dm), 3)
    out = decision.critic_topsis(df, ["a", "b", "c"], "id")
    rows = out["topsis_matrix"].orderBy("ranking").collect()
    assert [r.id for r in rows] == sorted(range(40), key=lambda i: (-c[i], i))
    best = out["best_result"].first()
    assert (best.id, best.closeness) == (rows[0].id, c.max())
    assert np.allclose(out["ideal_solutions"].toPandas()["a_plus"], w.max(0))


def test_grey_relation_pairs_weights_by_name(spark):
    x = np.array([[1.0, 10], [2, 40], [4, 20], [3, 30]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    z = (x - x.min(0)) / (x.max(0) - x.min(0))
    coef = 0.5 / (1 - z + 0.5)
    degree = coef @ [0.3, 0.7]
    out = decision.grey_relation(df, "id", {"b": 0.7, "a": 0.3})
    rows = out["grey_matrix_ranking"].orderBy("ranking").collect()
    assert [r.id for r in rows] == list(np.argsort(-degree)) and rows[0].degree == round(degree.max(), 3)
    assert out["score_matrix"].first().score == pytest.approx((coef.mean(0) * [0.3, 0.7]).sum() / 2)


def test_sobol_of_a_linear_model(spark):
    model = models.LinearModel(("a", "b", "c"), (1.0, -2.0, 0.0), 5.0)
    out = {r.name: r.value for r in analyze.sobol(spark, model, {"a": (0, 3), "b": (1, 2), "c": (0, 9)}, 4000).collect()}
    assert out["a"] == pytest.approx(9 / 13, abs=0.02) and out["b"] == pytest.approx(4 / 13, abs=0.02)
    assert out["c"] == pytest.approx(0, abs=0.02)


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2, 3, 5]), np.array([1.5, 2, 2, 6])
    df = frame(spark, np.column_stack([y, p]), ["y", "p"])
    got = {r.evaluate: r.value for r in evaluate.regression_evaluate(df, "y", "p").collect()}
    mse = ((y - p) ** 2).mean()
    assert got == pytest.approx({"r2": 1 - mse / y.var(), "mse": mse, "rmse": mse**0.5, "mae": np.abs(y - p).mean()})
    assert [r.evaluate for r in evaluate.regression_evaluate(df, "y", "p", ["mae"]).collect()] == ["mae"]
    with pytest.raises(ValueError):
        evaluate.regression_evaluate(df, "y", "p", ["nope"])


def test_classification_metrics(spark):
    df = frame(spark, [[1, 0.9], [1, 0.4], [0, 0.2], [0, 1.2], [1, 1.0], [0, 0.5]], ["y", "p"])
    got = {r.evaluate: r.value for r in evaluate.classification_evaluate(df, "y", "p").collect()}
    # 0.5 rounds to 0
    assert got["precision"] == pytest.approx(2 / 3) and got["recall"] == pytest.approx(2 / 3) and got["f1"] == pytest.approx(2 / 3)
    assert got["kappa"] == pytest.approx((4 / 6 - 0.5) / 0.5)


@pytest.mark.parametrize("score,band", [(-0.1, "none"), (0.1, "slight"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong"), (0.9, "almost perfect")])
def test_agreement_bands(spark, score, band):
    # n agreeing and n*(1-score)/(1+score) disagreeing rows give that kappa with even margins
    agree = round(500 * (1 + score))
    rows = [(i % 2, i % 2) for i in range(agree)] + [(i % 2, 1 - i % 2) for i in range(1000 - agree)]
    out = evaluate.consistency(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert out.score == pytest.approx(score, abs=0.01) and out.band == band


def test_equal_labels_agree_fully(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "a string, b string")
    assert evaluate.consistency(df, "a", "b").first().score == 1.0


def test_icc_from_anova(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=30) * 3
    p = y + rng.normal(size=30) + 0.5
    out = {r.type: r for r in evaluate.icc(frame(spark, np.column_stack([y, p]), ["y", "p"]), "y", "p").collect()}
    d = np.column_stack([y, p])
    n, k, g = 30, 2, d.mean()
    msb = k * ((d.mean(1) - g) ** 2).sum() / (n - 1)
    msj = n * ((d.mean(0) - g) ** 2).sum() / (k - 1)
    msw = ((d - d.mean(1, keepdims=True)) ** 2).sum() / (n * (k - 1))
    mse = ((d - d.mean(1, keepdims=True) - d.mean(0) + g) ** 2).sum() / ((n - 1) * (k - 1))
    assert out["ICC1"].icc == pytest.approx((msb - msw) / (msb + msw))
    assert out["ICC2"].icc == pytest.approx((msb - mse) / (msb + mse + k * (msj - mse) / n))
    assert out["ICC3k"].icc == pytest.approx((msb - mse) / msb)
    for r in out.values():
        assert r.ci_low <= round(r.icc, 2) <= r.ci_high
    f = msb / mse
    low = f / numeric.f_ppf(0.975, 29, 29)
    assert out["ICC3"].ci_low == round((low - 1) / (low + 1), 2)
