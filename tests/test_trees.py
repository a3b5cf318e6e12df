from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import histtrees as ht, trees


def plain_tree(x, y, w, leaves, depth, judge, least_leaf=1.0, ok=lambda left, right: True, outside=False):
    """Best-first by trying every cut of every leaf; returns the rows of each leaf, and with ``outside`` also those without weight."""
    parts = [(0, np.flatnonzero(w > 0))]  # (depth, rows)
    everyone = [np.arange(len(x))]

    def best(level, rows):
        out = None
        if level >= depth or w[rows].sum() < 2:
            return None
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(w[left].sum(), w[right].sum()) < least_leaf or not len(left) or not len(right) or not ok(left, right):
                    continue
                gain = round(judge(rows) - judge(left) - judge(right), 9)
                if gain > 0 and (out is None or gain > out[0]):
                    out = gain, left, right, f, cut
        return out

    cuts = [best(*p) for p in parts]
    while len(parts) < leaves and any(cuts):
        k = max((k for k in range(len(parts)) if cuts[k]), key=lambda k: (cuts[k][0], -k))
        _, left, right, f, cut = cuts[k]
        own = everyone[k]
        everyone[k] = own[x[own, f] <= cut]
        everyone.append(own[x[own, f] > cut])
        level = parts[k][0] + 1
        parts[k], cuts[k] = (level, left), best(level, left)
        parts.append((level, right))
        cuts.append(best(level, right))
    return list(zip((rows for _, rows in parts), everyone, strict=True)) if outside else [rows for _, rows in parts]


def table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 9, n) / 4, rng.integers(0, 5, n)]).astype(float)
    y = np.round(np.where(x[:, 0] > 6, 4.0, 1.0) * x[:, 1] + (x[:, 2] == 3) * 3 + rng.normal(size=n), 3)
    return x, y


def frame(spark, x, y, more=()):
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows + list(more), "id long, a double, b double, c double, y double").repartition(5)


X = ["a", "b", "c"]


def same(one, other):
    """The same trees; sums may differ in their last digits."""
    return [t[:4] for t in one.trees] == [t[:4] for t in other.trees] and np.allclose([v for t in one.trees for v in t[4]], [v for t in other.trees for v in t[4]])


def predictions(model, df):
    return np.array([r.prediction for r in model.predict(df).orderBy("id").collect()])


def values(parts, value, n):
    out = np.full(n, np.nan)
    for rows in parts:
        out[rows] = value(rows)
    return out


@pytest.mark.parametrize(("leaves", "depth", "least"), [(None, 3, 1), (5, None, 1), (9, 4, 10), (2, 1, 1), (7, None, 0.05)])
def test_squared_error(spark, leaves, depth, least):
    x, y = table()
    df = frame(spark, x, y, [(1000, None, 1.0, 1.0, 5.0), (1001, 1.0, 1.0, 1.0, None)])
    model = trees.fit_decision_tree(df, X, "y", depth, min_samples_leaf=least, max_leaf_nodes=leaves)
    parts = plain_tree(x, y, np.ones(400), leaves or 999, depth or 99, lambda r: ((y[r] - y[r].mean()) ** 2).sum(), math.ceil(least * 400) if least < 1 else least)
    want = values(parts, lambda r: y[r].mean(), 400)
    assert sum(f < 0 for f in model.trees[0][0]) == len(parts) == (leaves or len(parts))
    got = predictions(model, df)
    assert np.allclose(got[:400], want) and got[400] is None and got[401] is not None
    twin = trees.fit_decision_tree(df, X, "y", depth, min_samples_leaf=least, max_leaf_nodes=leaves, criterion="friedman_mse")
    assert same(twin, model)


def test_other_criteria(spark):
    x, y = table(seed=3)
    y = np.round(np.abs(y), 1)
    y[7], y[8] = 500.0, 900.0  # outliers: the absolute error cuts elsewhere
    df = frame(spark, x, y)
    model = trees.fit_decision_tree(df, X, "y", None, max_leaf_nodes=6, criterion="absolute_error")
    parts = plain_tree(x, y, np.ones(400), 6, 99, lambda r: np.abs(y[r] - np.median(y[r])).sum())
    assert np.allclose(predictions(model, df), values(parts, lambda r: np.median(y[r]), 400))
    squared = trees.fit_decision_tree(df, X, "y", None, max_leaf_nodes=6)
    assert not np.allclose(predictions(squared, df), predictions(model, df))
    poisson = trees.fit_decision_tree(df, X, "y", None, max_leaf_nodes=6, criterion="poisson")
    parts = plain_tree(x, y, np.ones(400), 6, 99, lambda r: -y[r].sum() * math.log(y[r].mean()) if y[r].sum() else 0.0, ok=lambda a, b: y[a].sum() > 0 and y[b].sum() > 0)
    assert np.allclose(predictions(poisson, df), values(parts, lambda r: y[r].mean(), 400))
    with pytest.raises(ValueError):
        trees.fit_decision_tree(frame(spark, x, -y), X, "y", criterion="poisson")


def test_nodes_in_parts_give_the_same(spark, monkeypatch):
    x, y = table(seed=5)
    df = frame(spark, x, y)
    model = trees.fit_random_forest(df, X, "y", 3, 4, key=["id"])
    monkeypatch.setattr(ht, "CELLS", 1)
    assert same(trees.fit_random_forest(df, X, "y", 3, 4, key=["id"]), model)


def test_many_features(spark, tmp_path):
    """Planning must not take time or memory that doubles with every feature."""
    rng = np.random.default_rng(11)
    v = rng.integers(0, 40, (300, 64)).astype(float)
    label = (v[:, 5] > 12).astype(float) + (v[:, 5] > 25)
    spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(v, label, strict=True))], "id long, v array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").select("id", *[F.col("v")[i].cast("double").alias(f"e{i}") for i in range(64)], F.col("label").cast("double").alias("label"))
    model = trees.fit_boosted(df, [f"e{i}" for i in range(64)], "label", "multiclass", num_leaves=3, num_boost_round=3, learning_rate=1.0)
    assert {f for t in model.trees for f in t[0]} == {-1, 5} and np.array_equal(predictions(model, df), label)


def test_more_values_than_bins_in_many_tasks(spark):
    """Tasks that meet few values each are together still found to have too many."""
    df = spark.range(0, 400, 1, 8).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    many, few = ht._cuts_of(df, ["a", "b"], 64)
    assert len(many) == 63 and few.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert ht._cuts_of(df.where("a < 65"), ["a", "b"], 65)[0].tolist() == [k + 0.5 for k in range(64)]
    assert [c.tolist() for c in ht._cuts_of(df.where("a < 0"), ["a", "b"], 64)] == [[], []]


def numbers(ids, seed):
    return np.array([int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:8], 16) % (ht._M - 1) + 1 for i in ids])


def test_forest_of_samples(spark):
    x, y = table(seed=6)
    df = frame(spark, x, y)
    model = trees.fit_random_forest(df, X, "y", 3, None, max_features="all", max_leaf_nodes=6, random_state=4, key=["id"])
    want, r = np.zeros(400), numbers(range(400), 4)
    for t in range(3):
        u = r.astype(object) * pow(48_271, t + 1, ht._M) % ht._M / ht._M
        w = np.array([next(k for k in range(13) if v <= sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for v in u], float)
        assert 0.85 < w.mean() < 1.15
        parts = plain_tree(x, y, w, 6, 99, lambda q, w=w: (w[q] * (y[q] - np.average(y[q], weights=w[q])) ** 2).sum())
        tree = model.trees[t]
        assert sorted(v for f, v in zip(tree[0], tree[4], strict=True) if f < 0) == pytest.approx(sorted(np.average(y[q], weights=w[q]) for q in parts))
        want += ht.walk(tree, x) / 3
    assert np.allclose(predictions(model, df), want)
    some = trees.fit_random_forest(df, X, "y", 4, 3, max_features=1, key=["id"])
    assert len({t[0][0] for t in some.trees}) > 1 and same(some, trees.fit_random_forest(df.repartition(2), X, "y", 4, 3, max_features=1, key=["id"]))


def plain_boost(x, y, kind, leaves, rounds, rate, r, seed=0, logistic=False, top=0.2, other=0.1, drop=0.1, skip=0.5, least=5):
    """Boosting written out round by round over all rows."""
    n = len(y)
    base = math.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    made, weights = [], []
    for k in range(rounds):
        rng = np.random.default_rng([seed, k])
        out = set()
        if kind == "dart" and k and rng.random() >= skip:
            out = set(np.flatnonzero(rng.random(k) < drop)[:50].tolist()) or {int(rng.integers(k))}
        s = base + sum((w * m for j, (w, m) in enumerate(zip(weights, made, strict=True)) if j not in out), np.zeros(n))
        p = 1 / (1 + np.exp(-s))
        g, h = (p - y, p * (1 - p)) if logistic else (s - y, np.ones(n))
        w = np.ones(n)
        if kind == "goss":
            size = np.abs(g * h)
            high = np.sort(size)[math.ceil((1 - top) * n) - 1]
            u = r.astype(object) * pow(48_271, k + 1, ht._M) % ht._M / ht._M
            w = np.where(size >= high, 1.0, np.where(u.astype(float) < other / (1 - top), (1 - top) / other, 0.0))
        g, h = g * w, h * w
        count = (w > 0).astype(float)
        parts = plain_tree(x, y, count, leaves, 99, lambda q: -g[q].sum() ** 2 / h[q].sum(), least, lambda a, b: min(h[a].sum(), h[b].sum()) >= 1e-3, outside=True)
        leaf = np.zeros(n)
        for rows, every in parts:
            leaf[every] = -g[rows].sum() / h[rows].sum()
        made.append(leaf)
        for j in out:
            weights[j] *= len(out) / (len(out) + 1)
        weights.append(rate / (len(out) + 1))
    return base + sum((w * m for w, m in zip(weights, made, strict=True)), np.zeros(n))


@pytest.mark.parametrize(("kind", "logistic", "rounds"), [("gbdt", True, 12), ("goss", False, 4), ("goss", True, 3), ("dart", False, 8)])
def test_boosting(spark, kind, logistic, rounds):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 6, 600), rng.integers(0, 4, 600), np.zeros(600)]).astype(float)
    y = x[:, 0] * (1 + x[:, 1]) + rng.normal(size=600)
    y = (y > 5).astype(float) if logistic else np.round(y, 3)
    df = frame(spark, x, y)
    model = trees.fit_boosted(df, X, "y", "binary" if logistic else "regression", kind, num_leaves=5, learning_rate=0.3, num_boost_round=rounds, seed=2, min_data_in_leaf=5, key=["id"])
    want = plain_boost(x, y, kind, 5, rounds, 0.3, numbers(range(600), 2), 2, logistic)
    assert not np.isnan(want).any() and all(sum(f < 0 for f in t[0]) <= 5 for t in model.trees) and sum(f < 0 for f in model.trees[0][0]) == 5
    assert np.allclose(model.raw(x)[:, 0], want, atol=1e-6)
    if logistic:
        assert (predictions(model, df) == (want > 0)).all()


def test_classes_and_many_leaves(spark, monkeypatch):
    x, _ = table(seed=8)
    y = (x[:, 0] > 6) * 1.0 + (x[:, 1] > 1) * 1.0 + 5
    df = frame(spark, x, y)
    for kind, rounds in (("gbdt", 11), ("rf", 4), ("dart", 3)):
        model = trees.fit_boosted(df, X, "y", "multiclass", kind, num_leaves=6, num_boost_round=rounds, learning_rate=0.3, min_data_in_leaf=2, key=["id"])
        assert (predictions(model, df) == y).mean() > 0.95 and set(model.classes) == {5.0, 6.0, 7.0}
        by_expression = predictions(model, df)
        with monkeypatch.context() as m:
            m.setattr(ht, "EXPRESSION_LEAVES", 0)
            assert (predictions(model, df) == by_expression).all()
    with pytest.raises(ValueError):
        trees.fit_boosted(df, X, "y", "binary")


def test_continuous_features_and_odd_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = np.where(x[:, 0] > 0.3, 5.0, 0.0) + np.where(x[:, 1] < -1, 2.0, 0.0)
    df = frame(spark, x, y)
    model = trees.fit_decision_tree(df, X, "y", None, max_leaf_nodes=4, max_bins=128)
    assert ((predictions(model, df) - y) ** 2).mean() < 0.1 * y.var()
    empty = trees.fit_decision_tree(df.limit(0), X, "y")
    assert predictions(empty, df.limit(3)).tolist() == [0.0] * 3
    one = trees.fit_boosted(df.limit(1), X, "y", num_boost_round=2)
    assert len(set(predictions(one, df.limit(5)).tolist())) == 1
    assert trees.features_per_cut("sqrt", 9) == 3 and trees.features_per_cut("0.5", 9) == 5 and trees.features_per_cut(4, 9) == 4 and trees.features_per_cut(None, 9) == 9


def test_rows_are_summed_by_combination_of_bins(spark, monkeypatch):
    """Passes read a row a combination of bins, not the rows; trees, forests and boosting stay the same."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(a * b % 7 + rng.integers(0, 3))) for a, b in rng.integers(0, 5, (600, 2))] + [(None, 1.0, 2.0), (1.0, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    made = []
    plain = ht.binned

    def seen(*args, **options):
        made.append(plain(*args, **options))
        made[-1].read = made[-1].table.count()
        return made[-1]

    monkeypatch.setattr(ht, "binned", seen)
    fits = [lambda: trees.fit_boosted(df, ["a", "b"], "y", num_leaves=4, num_boost_round=2), lambda: trees.fit_random_forest(df, ["a", "b"], "y", 3, 3)]
    summed = [f() for f in fits]
    assert [(m.read, m.rows) for m in made] == [(25, 600)] * 2
    monkeypatch.setattr(ht, "CELLS", 40)  # too few for the sums, so the rows themselves are read
    for one, f in zip(summed, fits, strict=True):
        other = f()
        assert one.base == pytest.approx(other.base) and len(one.trees) == len(other.trees)
        for s, t in zip(one.trees, other.trees, strict=True):
            assert s[:4] == t[:4] and s[4] == pytest.approx(t[4])
    assert [m.read for m in made[2:]] == [600] * 2


@pytest.mark.parametrize("most", [2, 3, 4, 300])
def test_cuts_between_values_or_at_quantiles(spark, most):
    values = [1.0, 2.0, 2.0, 4.0, 8.0, 8.0]
    df = spark.createDataFrame([(v, 0.5) for v in values], "a double, b double").repartition(3)
    a, b = ht._cuts_of(df, ["a", "b"], most)
    assert len(b) == 0 and (a.tolist() == [1.5, 3.0, 6.0] if most >= 4 else len(a) <= most - 1 and set(a) <= set(values))
