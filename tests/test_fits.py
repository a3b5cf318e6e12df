from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import curvefit, models, regression as reg, trees


def table(spark, x, y, extra=None):
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [tuple(map(float, (*r, v))) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "y"])), cols


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [3, -2, 1]
    y = x @ [2.0, -0.3, 0.0] + 4 + rng.normal(size=300) * 0.5
    df, cols = table(spark, x, y)
    return x, y, df, cols


def test_ridge(data):
    x, y, df, cols = data
    m = reg.fit_ridge(df, cols, "y", alpha=7.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coef, w) and m.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


def test_ridge_by_leave_one_out(data):
    x, y, df, cols = data

    def loo(alpha):
        err = 0.0
        for i in range(len(y)):
            k = np.arange(len(y)) != i
            mx, my = x[k].mean(0), y[k].mean()
            xc = x[k] - mx
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y[k] - my))
            err += (y[i] - my - (x[i] - mx) @ w) ** 2
        return err

    model, alpha = reg._ridge_loo(df, cols, "y", (0.1, 1.0, 10.0, 300.0))
    # the centred shortcut is exact up to the shift of the mean
    assert alpha == min((0.1, 1.0, 10.0, 300.0), key=loo)
    assert model == reg.fit_ridge(df, cols, "y", alpha)


@pytest.mark.parametrize("penalty,ratio", [("l1", 1.0), ("both", 0.5)])
def test_cross_validated_fit_is_optimal(spark, data, penalty, ratio):
    x, y, df, cols = data
    numbered = spark.createDataFrame([tuple(map(float, (i, *r, v))) for i, (r, v) in enumerate(zip(x, y))],
                                     "i double, x0 double, x1 double, x2 double, y double")
    model, alpha = reg._cross_validated(numbered, cols, "y", ratio, 30, 5000, 5, ["i"], tol=1e-10)
    w = np.array(model.coef)
    xc, yc = x - x.mean(0), y - y.mean()
    grad = xc.T @ (yc - xc @ w) / len(y) - alpha * (1 - ratio) * w
    for j in range(3):  # optimality conditions of the penalised problem
        if w[j]:
            assert grad[j] == pytest.approx(alpha * ratio * np.sign(w[j]), abs=1e-6)
        else:
            assert abs(grad[j]) <= alpha * ratio + 1e-9
    # the chosen strength has the least error over contiguous folds
    from tablewright.core.numeric import elastic_net
    top = np.abs(xc.T @ yc).max() / len(y) / ratio
    errs = []
    for a in np.geomspace(top, top * 1e-3, 30):
        e = 0
        for f in np.array_split(np.arange(len(y)), 5):
            k = np.setdiff1d(np.arange(len(y)), f)
            mx, my = x[k].mean(0), y[k].mean()
            g, c = (x[k] - mx).T @ (x[k] - mx), (x[k] - mx).T @ (y[k] - my)
            v = elastic_net(g, c, len(k), a, ratio, 5000, 1e-10)
            e += np.mean((y[f] - my - (x[f] - mx) @ v) ** 2)
        errs.append((e, a))
    assert alpha == pytest.approx(min(errs)[1])


@pytest.mark.parametrize("scale", [True, False])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_pls_matches_nipals(data, scale, k):
    x, y, df, cols = data
    m = reg.fit_pls(df, cols, "y", k, scale=scale)
    sx = x.std(0, ddof=1) if scale else np.ones(3)
    sy = y.std(ddof=1) if scale else 1.0
    xk, yk = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    ws, ps, qs = [], [], []
    for _ in range(k):
        w = xk.T @ yk
        w /= np.linalg.norm(w)
        t = xk @ w
        p, q = xk.T @ t / (t @ t), yk @ t / (t @ t)
        xk, yk = xk - np.outer(t, p), yk - t * q
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    coef = w @ np.linalg.inv(p.T @ w) @ np.array(qs) * sy / sx
    assert np.allclose(m.coef[0], coef, rtol=1e-6)


def test_pls_two_labels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ rng.normal(size=(3, 2))
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y)], "a double, b double, c double, u double, v double")
    m = reg.fit_pls(df, ["a", "b", "c"], ["u", "v"], 3)
    out = m.predict(df).toPandas()
    assert np.allclose(out["prediction_u"], out["u"], atol=1e-6) and np.allclose(out["prediction_v"], out["v"], atol=1e-6)


@pytest.mark.parametrize("C", [0.01, 20.0])
def test_svr_reaches_the_minimum(data, C):
    x, y, df, cols = data
    m = reg.fit_svr(df, cols, "y", C=C, epsilon=0.2)

    def loss(w, b):
        return 0.5 * w @ w + C * np.maximum(np.abs(y - x @ w - b) - 0.2, 0).sum()

    w, b = np.array(m.coef), m.intercept
    at = loss(w, b)
    rng = np.random.default_rng(0)
    for size in (1e-3, 1e-2, 1e-1):
        for _ in range(300):
            assert loss(w + rng.normal(size=3) * size, b + rng.normal() * size) >= at * (1 - 3e-4)


def test_exponential_paths_agree(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, (a, b, c) in {"p": (5, 0.3, 1), "q": (-2, 0.7, 4)}.items():
        t = rng.random(120) * 10
        rows += [(g, float(v), float(a * np.exp(-b * v) + c + rng.normal() * 0.01)) for v in t]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    local = {r.g: r for r in curvefit.fit_exponential(df, "x", "y", (1, 0.5, 1), by="g").collect()}
    spread = {r.g: r for r in curvefit.fit_exponential(df, "x", "y", (1, 0.5, 1), by="g", limit=0).collect()}
    mixed = {r.g: r for r in curvefit.fit_exponential(df.where("g = 'p' or x < 5"), "x", "y", (1, 0.5, 1), by="g", limit=100).collect()}
    assert set(mixed) == {"p", "q"}
    for g, want in {"p": (5, 0.3, 1), "q": (-2, 0.7, 4)}.items():
        for fit in (local[g], spread[g]):
            assert (fit.a, fit.b, fit.c) == pytest.approx(want, abs=0.05)
        assert (local[g].a, local[g].b, local[g].c) == pytest.approx((spread[g].a, spread[g].b, spread[g].c), rel=1e-6)
        assert local[g].n == 120


@pytest.mark.parametrize("limit", [0, 10_000])
def test_repeated_x_is_fitted_from_its_points(spark, limit):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, 4000).astype(float)
    y = 5 * np.exp(-0.3 * x) + 1 + 1000 + rng.normal(size=4000)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    r = curvefit.fit_exponential(df, "x", "y", (4, 0.2, 900), by="g", limit=limit).first()
    # Brute force over all rows: no step from the fit lowers the sum of squares.
    def sse(a, b, c):
        return float(((y - a * np.exp(-b * x) - c) ** 2).sum())
    assert r.sse == pytest.approx(sse(r.a, r.b, r.c), rel=1e-9) and r.n == 4000 and r.converged
    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert sse(*(np.array([r.a, r.b, r.c]) + step)) > r.sse
    few = curvefit.fit_exponential(df, "x", "y", (4, 0.2, 900), by="g", limit=limit, max_iter=2).first()
    assert not few.converged
    points = curvefit._points(df.select("g", F.col("x").alias("_x"), F.col("y").alias("_y")), ["g"])
    assert points.count() == 12


def test_exponential_overflow_is_an_error(spark):
    df = spark.createDataFrame([(float(-i * 1000), 1.0) for i in range(5)], "x double, y double")
    with pytest.raises(curvefit.FitError):
        curvefit.fit_exponential(df, "x", "y", (1, 2, 3))


def test_logarithm_exact(spark):
    df = spark.createDataFrame([(float(x), float(3 + 2 * np.log10(x))) for x in range(1, 30)], "x double, y double")
    r = curvefit.fit_logarithm(df, "x", "y").first()
    assert (r.a, r.b) == pytest.approx((3.0, 2.0))
    m = curvefit.logarithm_model(curvefit.fit_logarithm(df, "x", "y"), "x")
    out = models.model_apply(df.select("x"), m, ["v", "fit"])
    assert out.columns == ["v", "fit"]
    with pytest.raises(ValueError):
        models.model_apply(df.select("x"), m, ["v"])


@pytest.mark.parametrize("limit", [0, 10_000])
def test_weibull_recovers_two_peaks(spark, limit):
    def curve(t, k, m, a):
        return k * m * a * t ** (m - 1) * np.exp(-a * t**m)

    t = np.arange(1, 41, dtype=float)
    y = np.concatenate([curve(t, 100, 2.0, 0.01), curve(t, 70, 1.5, 0.05)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
    out = curvefit.fit_weibull(df, "y", "i", regions=[(1, 40), (41, 80)], guess=((1.8, 0.02), (1.8, 0.03)), limit=limit)
    model = curvefit.weibull_model(out)
    assert model.m == pytest.approx((2.0, 1.5), rel=0.02)
    assert model.a == pytest.approx((0.01, 0.05), rel=0.05)
    with pytest.raises(ValueError):
        curvefit.fit_weibull(df, "y", "i", regions=[(1, 2)], guess=((1, 1), (1, 1)))


def test_weibull_curve_example(spark):
    costs = spark.createDataFrame([(5, 100.0)], "time int, total_cost double")
    out = curvefit.weibull_curve(costs, models.WeibullModel((2.0,), (0.01,))).orderBy("a").collect()
    assert [(r.a, r.b) for r in out] == [(1, 1.9801), (2, 3.84316), (3, 5.48359), (4, 6.81715), (5, 7.78801)]


def test_models_are_versioned(spark, data, tmp_path):
    x, y, df, cols = data
    root = str(tmp_path)
    ridge = reg.fit_ridge(df, cols, "y")
    tree = trees.fit_decision_tree(df, cols, "y", max_depth=3)
    assert models.save_model(spark, ridge, root, "m") == 1
    assert models.save_model(spark, tree, root, "m") == 2
    assert models.load_model(spark, root, "m", 1) == ridge
    got = models.load_model(spark, root, "m").predict(df.select(*cols)).toPandas()["prediction"]
    assert np.allclose(got, tree.predict(df.select(*cols)).toPandas()["prediction"])
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, root, "m", 7)
    for m in (models.ExponentialModel("x", 1, 2, 3), models.LogarithmModel("x", 1, 2), models.WeibullModel((1.0, 2.0), (0.1, 0.2)),
              reg.fit_pls(df, cols, "y")):
        models.save_model(spark, m, root, "other")
        assert models.load_model(spark, root, "other") == m


def test_tree_models_learn(spark, data):
    x, y, df, cols = data
    base = y.var()
    for model in (trees.fit_decision_tree(df, cols, "y"), trees.fit_random_forest(df, cols, "y", 5, min_weight_fraction_leaf=0.01),
                  trees.fit_boosted(df, cols, "y", num_leaves=8, num_boost_round=8, learning_rate=0.3),
                  trees.fit_boosted(df, cols, "y", boosting_type="rf", num_leaves=16, num_boost_round=5)):
        out = model.predict(df).toPandas()
        assert ((out["prediction"] - out["y"]) ** 2).mean() < 0.5 * base


def test_k_means_finds_groups(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(size=(50, 2)) + c for c in ([0, 0], [20, 0], [0, 20])])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double")
    sizes = trees.k_means(df, ["a", "b"], 3, seed=1).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [50, 50, 50]


def test_boosting_types(spark):
    df = spark.createDataFrame([(float(i), float(i % 7 > 3)) for i in range(60)], "x double, y double")
    for kind in ("rf", "gbdt", "dart", "goss"):
        model = trees.fit_boosted(df, ["x"], "y", "binary", kind, num_leaves=16, num_boost_round=5, min_data_in_leaf=1)
        assert {r.prediction for r in model.predict(df).select("prediction").distinct().collect()} <= {0.0, 1.0}
    with pytest.raises(ValueError):
        trees.fit_boosted(df, ["x"], "y", boosting_type="other")
    with pytest.raises(ValueError):
        trees.fit_random_forest(df, ["x"], "y", criterion="other")
