from __future__ import annotations

import math

import numpy as np
import pytest

from tablewright.operators import arma, series


def ar_frame(spark, n=150, phi=0.6, mu=20.0, seed=1, extra=()):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        w = [mu]
        for _ in range(n - 1):
            w.append(mu + phi * (w[-1] - mu) + rng.normal())
        rows += [(s, i, float(v)) for i, v in enumerate(w)]
    return rows, spark.createDataFrame(rows, "s string, i int, y double")


def exact_ar1(w):
    """Grid over the exact likelihood of an AR(1) with mean."""
    n, best = len(w), None
    for phi in np.arange(-0.99, 0.99, 0.0005):
        a, b = 1 - phi**2, (1 - phi) ** 2
        mu = (a * w[0] + (1 - phi) * (w[1:] - phi * w[:-1]).sum()) / (a + (n - 1) * b)
        s = a * (w[0] - mu) ** 2 + ((w[1:] - mu - phi * (w[:-1] - mu)) ** 2).sum()
        nll = n * math.log(s / n) - math.log(a)
        if best is None or nll < best[0]:
            best = (nll, phi, mu)
    return best[1], best[2]


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_ar1_maximises_the_exact_likelihood(spark, limit):
    rows, df = ar_frame(spark)
    out = series.arima_forecast(df, "y", "i", 1, 0, 0, 3, by="s", limit=limit).collect()
    for s in ("a", "b"):
        w = np.array([r[2] for r in rows if r[0] == s])
        phi, mu = exact_ar1(w)
        got = [r.y for r in sorted(out, key=lambda r: r.step) if r.s == s]
        assert got == pytest.approx([mu + phi**k * (w[-1] - mu) for k in (1, 2, 3)], abs=5e-3)


def test_ar_helpers():
    phi = np.array([0.5, -0.3, 0.1])
    assert np.allclose(arma.from_partial(series._to_partial(phi)), phi)
    v = series._start_covariance(np.array([0.6]))
    assert v[0, 0] == pytest.approx(1 / (1 - 0.36))
    g = series._start_covariance(np.array([0.5, 0.2]))
    assert g[0, 1] / g[0, 0] == pytest.approx(0.5 / (1 - 0.2))


def test_differenced_walk_keeps_its_level(spark):
    rows = [(i, float(3 * i + 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, y double")
    # second differences vanish, so the line goes on
    out = series.arima_forecast(df, "y", "i", 0, 2, 0, 4).orderBy("step").collect()
    assert [r.y for r in out] == pytest.approx([3 * i + 5 for i in range(30, 34)])
    one = series.arima_forecast(df, "y", "i", 0, 1, 0, 2).orderBy("step").collect()
    assert [r.y for r in one] == pytest.approx([92.0, 92.0])
    mean = series.arima_forecast(df, "y", "i", 0, 0, 0, 1).first()
    assert mean.y == pytest.approx(np.mean([v for _, v in rows]))


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_moving_average_part_is_recovered(spark, limit):
    rng = np.random.default_rng(7)
    e = rng.normal(size=3001)
    w = 10 + e[1:] + 0.5 * e[:-1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i int, y double")
    out = series.arima_forecast(df, "y", "i", 0, 0, 1, 2, limit=limit).orderBy("step").collect()
    assert out[0].y == pytest.approx(10 + 0.5 * e[-1], abs=0.15)
    assert out[1].y == pytest.approx(10, abs=0.15)


def dense(w, phi, theta, steps):
    """Loss, mean and forecasts from the full covariance matrix of the series."""
    m = arma.Models(np.array([phi], float).reshape(1, -1), np.array([theta], float).reshape(1, -1))
    n, t, state, gamma = len(w), m.parts()[0][0], m.covariance()[0], []
    for _ in range(n + steps):
        gamma.append(state[0, 0])
        state = t @ state
    gamma = np.array(gamma)
    inverse = np.linalg.inv(gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])
    mu = inverse.sum(axis=0) @ w / inverse.sum()
    z = w - mu
    ahead = [mu + gamma[n - 1 + h - np.arange(n)] @ inverse @ z for h in range(1, steps + 1)]
    return math.log(z @ inverse @ z / n) - np.linalg.slogdet(inverse)[1] / n, mu, ahead


@pytest.mark.parametrize(("phi", "theta"), [([], [0.98]), ([0.7], [-0.4]), ([0.5, -0.3], [0.8, 0.2]), ([0.99], []), ([], [-0.5, 0.3, 0.1])])
def test_likelihood_against_dense_covariance(phi, theta):
    rng = np.random.default_rng(4)
    w = rng.normal(size=150).cumsum() / 5 + rng.normal(size=150) + 3
    m = arma.Models(np.array([phi], float).reshape(1, -1), np.array([theta], float).reshape(1, -1))
    loss, mu, ahead = dense(w, phi, theta, 3)
    whole = arma.summed(m, w)
    got, mean, state = arma.concluded(m, whole, True)
    assert got[0] == pytest.approx(loss, abs=1e-10) and mean[0] == pytest.approx(mu, abs=1e-9) and arma.forecast(m, mean[0], state[0], 3) == pytest.approx(ahead, abs=1e-8)
    for cuts in ([70], [1, 2, 149], [30, 60, 90]):
        parts = [arma.summed(m, x) for x in np.split(w, cuts)]
        joined = parts[0].then(parts[1])
        for s in parts[2:]:
            joined = joined.then(s)
        row = arma.Stretch.from_row(joined.to_row(), 1, joined.out.shape[1])
        assert np.allclose(row.gram, whole.gram) and np.allclose(row.out, whole.out) and row.n == 150


def test_theta_near_one(spark):
    """Slowly fading noise weights: the whole past counts, and the search ends at the best of a fine lattice."""
    rng = np.random.default_rng(12)
    e = rng.normal(size=2001)
    w = e[1:] + 0.98 * e[:-1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i int, y double")
    got = series.arima_forecast(df, "y", "i", 0, 0, 1, 2).orderBy("step").collect()
    best = []
    for th in np.arange(0.9, 1.0, 0.0005):
        m = arma.Models(np.zeros((1, 0)), np.array([[th]]))
        loss, mu, state = arma.concluded(m, arma.summed(m, w), True)
        best.append((loss[0], arma.forecast(m, mu[0], state[0], 2)))
    assert [r.y for r in got] == pytest.approx(min(best)[1], abs=0.02)


def test_any_blocks_give_the_same(spark):
    """Series of one block and of many blocks, composed in rounds on Spark."""
    rng = np.random.default_rng(10)
    rows = []
    for g, n in (("a", 400), ("b", 37), ("c", 5), (None, 90)):
        e = rng.normal(size=n + 1)
        rows += [(g, i, float(50 + v)) for i, v in enumerate(e[1:] + 0.6 * e[:-1])]
    df = spark.createDataFrame(rows, "g string, i int, y double")
    outs = [{(r.g, r.step): r.y for r in series.arima_forecast(df, "y", "i", p, d, 1, 2, by="g", block=block).collect()} for p, d in ((0, 0), (1, 1)) for block in (1 << 18, 16)]
    for a, b in (outs[:2], outs[2:]):
        assert len(a) == 8 and a == pytest.approx(b, abs=1e-5)
    one = df.where("g = 'a'").select("i", "y")
    whole, cut = ([r.y for r in series.arima_forecast(one, "y", "i", 0, 0, 1, 2, block=block).orderBy("step").collect()] for block in (1 << 18, 1))
    assert whole == pytest.approx(cut, abs=1e-5) and whole == pytest.approx([outs[0]["a", 1], outs[0]["a", 2]], abs=1e-5)


def test_mixed_model_is_recovered(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=4000)
    w = np.zeros(4000)
    for t in range(1, 4000):
        w[t] = 0.7 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    level = np.cumsum(w) + 100
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(level)], "s string, i int, y double")
    out = series.arima_forecast(df, "y", "i", 1, 1, 1, 2, by="s").orderBy("step").collect()
    one = 0.7 * w[-1] + 0.4 * e[-1]
    assert out[0].y == pytest.approx(level[-1] + one, abs=0.25)
    assert out[1].y == pytest.approx(level[-1] + one + 0.7 * one, abs=0.5)


def grey(x, y, ahead):
    """Textbook GM(1,N) written out step by step."""
    full = np.vstack([x, ahead])
    x1, y1 = np.cumsum(full, axis=0), np.cumsum(y)
    n = len(y)
    b = np.column_stack([-(y1[1:] + y1[:-1]) / 2, x1[1:n]])
    sol = np.linalg.pinv(b.T @ b) @ b.T @ y[1:]
    u = x1 @ sol[1:] / sol[0]
    f = (y[0] - u) / np.exp(sol[0] * np.arange(1, len(full) + 1)) + u
    return np.diff(np.concatenate([[0], f]))[n:]


@pytest.mark.parametrize("limit", [1_000_000, 4])
def test_gm1n(spark, limit):
    rng = np.random.default_rng(3)
    train, future, want = [], [], {}
    for s in ("a", "b"):
        x = rng.random((15, 2)) * 5 + 1
        y = x[:, 0] * 2 + x[:, 1] + 3
        train += [(s, i, *map(float, x[i]), float(y[i])) for i in range(12)]
        future += [(s, i, *map(float, x[i])) for i in range(12, 15)]
        want[s] = grey(x[:12], y[:12], x[12:])
    t = spark.createDataFrame(train, "s string, i int, u double, v double, y double")
    f = spark.createDataFrame(future, "s string, i int, u double, v double")
    out = series.gm1n(t, f, ["u", "v"], "y", "i", by="s", limit=limit).collect()
    assert out[0].asDict().keys() == {"s", "i", "u", "v", "gm1n_pre"}
    for s in want:
        got = [r.gm1n_pre for r in sorted(out, key=lambda r: r.i) if r.s == s]
        assert got == pytest.approx(list(np.round(want[s], 3)), abs=2e-3)


def test_series_are_fitted_by_themselves(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(size=201)
    long = [("a", i, float(5 + e[i] + 0.6 * e[i - 1])) for i in range(1, 201)]
    short = [("b", i, float(rng.normal())) for i in range(9)]
    def forecast(rows):
        df = spark.createDataFrame(rows, "g string, t int, y double")
        out = series.arima_forecast(df, "y", "t", 0, 0, 1, 2, by="g").where("g = 'a'").orderBy("step").collect()
        return [r.y for r in out]
    assert forecast(long) == pytest.approx(forecast(long + short), abs=1e-9)
