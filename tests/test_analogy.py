from __future__ import annotations

import numpy as np
import pytest

from tablewright.operators.analogy import analogy, analogy_weights


def brute(base, targets, weights, L):
    """Every pair compared, top three blended; rows are (id, features..., y)."""
    k = len(weights)
    tops = np.array([r[1:1 + k] for r in base + targets], dtype=float).max(axis=0)

    def vec(r):
        return [0.0 if m == 0 else v / m * w for v, m, w in zip(r[1:1 + k], tops, weights)]

    out = {}
    for t in targets:
        u = vec(t)
        sims = []
        for r in base:
            v = vec(r)
            high = sum(map(max, u, v))
            sims.append((-(round(sum(map(min, u, v)) / high, 5) if high else 0.0), r[0], r[-1]))
        top = sorted(sims)[:3]
        b, e = [-s for s, _, _ in top], [y for _, _, y in top]
        val, rest = 0.0, 1.0
        for bi, ei in zip(b, e):
            val += rest * bi * ei
            rest *= 1 - bi
        if len(top) == 3:
            val += rest * sum(e) / 3
        out[t[0]] = L * val
    return out


def compare(spark, base, targets, weights, L=1.2):
    names = [f"f{i}" for i in range(len(weights))]
    schema = "id long, " + ", ".join(f"{n} double" for n in names) + ", y double"
    b, t = spark.createDataFrame(base, schema), spark.createDataFrame(targets, schema)
    got = {r.id: r.y for r in analogy(b, t, names, "y", dict(zip(names, weights)), L, "id").collect()}
    want = brute(base, targets, weights, L)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("kind", ["spread", "duplicates", "clustered", "one_feature", "five_features", "outlier"])
def test_matches_every_pair(spark, kind):
    rng = np.random.default_rng(sorted(["spread", "duplicates", "clustered", "one_feature", "five_features", "outlier"]).index(kind))
    p = {"one_feature": 1, "five_features": 5}.get(kind, 3)
    x = rng.random((260, p)) * 100
    if kind == "duplicates":
        x = np.round(x / 40) * 40
        x[rng.random(260) < 0.4] = x[0]  # a group of equal rows holds over a third
    if kind == "clustered":
        x = 50 + rng.normal(size=(260, p)) * 0.5
        x[:20] = rng.random((20, p)) * 100
    if kind == "outlier":
        x[5] = 1e6
        x[7] = 0.0
    rows = [(i, *map(float, r), float(rng.integers(1, 500))) for i, r in enumerate(x)]
    weights = list(rng.random(p))
    compare(spark, rows[:200], [(*r[:-1], 0.0) for r in rows[200:]], weights)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_known_rows(spark, n):
    base = [(i, float(10 + i), float(5 - i), 100.0 * (i + 1)) for i in range(n)]
    compare(spark, base, [(9, 10.5, 4.0, 0.0), (10, 10.5, 4.0, 0.0)], [0.5, 0.5])


def test_negative_features_are_refused(spark):
    df = spark.createDataFrame([(1, -1.0, 2.0)], "id long, f0 double, y double")
    with pytest.raises(ValueError):
        analogy(df, df, ["f0"], "y", {"f0": 1.0})


def test_weights_are_shares(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0)], "a double, b double")
    assert analogy_weights(df, ["a", "b"]) == {"a": 0.3, "b": 0.7}


@pytest.mark.parametrize("features", [1, 10])
def test_blocks_are_exact_and_few(spark, monkeypatch, features):
    from tablewright.operators import analogy as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    monkeypatch.setattr(module, "SLICE_ROWS", 30)
    monkeypatch.setattr(module, "BOXES", 3)
    routed = []
    plain = module._routed

    def counted(*args):
        out = plain(*args)
        routed.append(out.count())
        return out

    monkeypatch.setattr(module, "_routed", counted)
    rng = np.random.default_rng(features)
    names = [f"f{i}" for i in range(features)]
    base, aims = rng.random((400, features)).round(3), rng.random((70, features)).round(3)
    known = spark.createDataFrame([(*map(float, r), i, float(i)) for i, r in enumerate(base)], [*names, "id", "y"])
    wanted = spark.createDataFrame([(*map(float, r), 1_000 + i, None) for i, r in enumerate(aims)], ", ".join([*(f"{n} double" for n in names), "id long", "y double"]))
    weights = dict.fromkeys(names, 1 / features)
    got = {r.id: r.y for r in module.analogy(known, wanted, names, "y", weights, order_by="id").collect()}
    top = np.maximum(base.max(axis=0), aims.max(axis=0))
    for i, t in enumerate(aims):
        a, b = t / top / features, base / top / features
        sim = np.floor(np.minimum(a, b).sum(1) / np.maximum(a, b).sum(1) * 1e5 + 0.5) / 1e5
        k = np.lexsort((np.arange(400), -sim))[:3]
        s, y = sim[k], k.astype(float)
        want = s[0] * y[0] + (1 - s[0]) * s[1] * y[1] + (1 - s[0]) * (1 - s[1]) * (s[2] * y[2] + (1 - s[2]) * y.sum() / 3)
        assert got[1_000 + i] == pytest.approx(want, rel=1e-9)
    # rows sent on are targets by blocks, never targets by known rows
    assert routed[0] <= 70 * 10 and (features > 1 or routed[0] < 70 * 5)


def test_three_best_are_the_first_of_equals():
    from tablewright.operators.analogy import _three_best

    sim = np.random.default_rng(2).integers(0, 4, (50, 30)) / 4
    for width in (1, 2, 3, 30):
        part = sim[:, :width].copy()
        assert (_three_best(part) == np.argsort(-part, axis=1, kind="stable")[:, :3]).all()
        assert (part == sim[:, :width]).all()
