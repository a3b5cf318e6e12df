"""Tree models grown from histograms, and clustering on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tablewright.core.session import discard, stable
from tablewright.core.types import quoted, require_numeric
from tablewright.operators import histtrees as ht
from tablewright.operators.histtrees import TreeModel

CRITERIA = {"squared_error": "squared_error", "mse": "squared_error", "variance": "squared_error", "friedman_mse": "squared_error",
            "absolute_error": "absolute_error", "mae": "absolute_error", "poisson": "poisson"}
MOST_CLASSES = 100


def _ready(df: DataFrame, x: Sequence[str]) -> DataFrame:
    require_numeric(df, x)
    rows = df.select(*[quoted(c) for c in x]).na.drop()
    return VectorAssembler(inputCols=list(x), outputCol="_features").transform(rows).select("_features")


def _criterion(name: str) -> str:
    """Friedman's improvement orders cuts as the squared error does."""
    if name not in CRITERIA:
        raise ValueError(f"criterion {name!r} is not offered")
    return CRITERIA[name]


def _rows(v: float, n: int, least: int) -> float:
    """A number of rows, or a share of them when below 1."""
    return max(least, v if v >= 1 else math.ceil(v * n))


def features_per_cut(asked, p: int) -> int:
    """How many of p features a cut looks at: a number, a share, or a name."""
    text = "all" if asked is None else str(asked)
    if text in ("all", "auto"):
        return p
    if text in ("sqrt", "log2", "onethird"):
        return max(1, int({"sqrt": math.sqrt(p), "log2": math.log2(p), "onethird": p / 3}[text]))
    return max(1, min(p, math.ceil(float(text) * p) if "." in text else int(text)))


def _some(seed: int, p: int, k: int):
    """The features of a (tree, node), drawn by seed."""
    return lambda tree, node: sorted(np.random.default_rng([seed, tree, node]).choice(p, k, replace=False).tolist())


def fit_decision_tree(df: DataFrame, x: Sequence[str], y: str, max_depth: int | None = 5,
                      min_samples_split: float = 2, min_samples_leaf: float = 1,
                      max_leaf_nodes: int | None = None, max_bins: int = 64, seed: int = 0,
                      max_features: str | float | None = None, criterion: str = "squared_error") -> TreeModel:
    """Regression tree; with ``max_leaf_nodes`` the best cuts first, until it has that many leaves.

    ``criterion`` is the squared error (or Friedman's), the absolute error, or Poisson deviance.
    """
    return fit_random_forest(df, x, y, 1, max_depth, min_samples_split, min_samples_leaf, max_features=max_features or "all",
                             max_leaf_nodes=max_leaf_nodes, bootstrap=False, random_state=seed, max_bins=max_bins, criterion=criterion)


def fit_random_forest(df: DataFrame, x: Sequence[str], y: str, n_estimators: int = 20, max_depth: int | None = 5,
                      min_samples_split: float = 2, min_samples_leaf: float = 1,
                      min_weight_fraction_leaf: float = 0.0, max_features: str = "sqrt",
                      max_leaf_nodes: int | None = None, min_impurity_decrease: float = 0.0,
                      bootstrap: bool = True, random_state: int = 0, max_bins: int = 64,
                      criterion: str = "squared_error", key: Sequence[str] | None = None) -> TreeModel:
    """Random forest regression; all trees grow together, one pass over the rows a level.

    Bootstrap samples take each row a Poisson number of times, by a hash of ``key`` (the row's
    own features and label when not given).
    """
    name = _criterion(criterion)
    data = ht.binned(df, x, y, max_bins, key, random_state, labels=name == "absolute_error",
                     draws=(int(n_estimators) if bootstrap else 0) if name == "squared_error" else None)
    try:
        n, p = data.rows, len(list(x))
        if name == "poisson" and data.table.where("_y < 0").limit(1).count():
            raise ValueError("Poisson deviance needs labels that are not negative")
        rule = ht.Rule(name, max(_rows(min_samples_leaf, n, 1), min_weight_fraction_leaf * n))

        summed = data.summed

        def statistics(cols, own, tree):
            if summed:
                w, a = (cols[f"_w{tree}"], cols[f"_a{tree}"]) if bootstrap else (cols["_n"], cols["_n"] * cols["_y"])
                return w, a, w
            w = ht.drawn(cols["_r"], tree) if bootstrap else np.ones(len(own))
            return w, w * cols["_y"], w

        k = features_per_cut(max_features, p)
        trees = ht.grow(data, data.table, int(n_estimators), rule, statistics, leaves=max_leaf_nodes, depth=max_depth if max_depth and max_depth > 0 else None,
                        least_gain=min_impurity_decrease * n, least_split=_rows(min_samples_split, n, 2), features=_some(random_state, p, k) if k < p else None)
    finally:
        data.drop()
    return TreeModel(tuple(x), tuple(ht.in_values(t, data.cuts) for t in trees), (1 / len(trees),) * len(trees), (0.0,))


def fit_boosted(df: DataFrame, x: Sequence[str], y: str, objective: str = "regression",
                boosting_type: str = "gbdt", num_leaves: int = 31, max_depth: int = -1,
                learning_rate: float = 0.1, feature_fraction: float = 1.0, bagging_fraction: float = 1.0,
                num_boost_round: int = 20, seed: int = 0, *, min_data_in_leaf: int = 20, min_sum_hessian_in_leaf: float = 1e-3,
                lambda_l2: float = 0.0, max_bins: int = 255, top_rate: float = 0.2, other_rate: float = 0.1,
                drop_rate: float = 0.1, max_drop: int = 50, skip_drop: float = 0.5, key: Sequence[str] | None = None) -> TreeModel:
    """Boosted trees of exactly ``num_leaves`` leaves where the rows allow it: regression, ``binary`` or ``multiclass``.

    ``gbdt``: every tree follows the gradient of all rows (or of a ``bagging_fraction``).
    ``goss``: the rows with the ``top_rate`` largest gradients, and of the others a sample of
    ``other_rate`` of all rows, weighted up to stand for the rest.
    ``dart``: each round leaves out some earlier trees, fits what is then missing, and scales
    the new tree and those left out so that together they weigh what those weighed.
    ``rf``: trees side by side, averaged. Samples follow a hash of ``key``, as in the forest.
    """
    if boosting_type not in ("gbdt", "rf", "goss", "dart"):
        raise ValueError(f"boosting type {boosting_type!r} is not offered")
    if objective not in ("regression", "binary", "multiclass"):
        raise ValueError(f"unknown objective {objective!r}")
    if boosting_type == "goss" and not (0 < top_rate < 1 and 0 < other_rate <= 1 - top_rate):
        raise ValueError("top_rate and other_rate must be shares that add up to 1 at most")
    plain = boosting_type in ("gbdt", "dart") and bagging_fraction >= 1  # no sample is drawn
    data = ht.binned(df, x, y, max_bins, key, seed, draws=0 if plain and objective == "regression" else None)
    classes: list[float] = []
    if objective != "regression":
        counts = {r["_y"]: r["count"] for r in data.table.groupBy("_y").count().limit(MOST_CLASSES + 1).collect()}
        classes = sorted(counts)
        if len(classes) > MOST_CLASSES or objective == "binary" and len(classes) > 2:
            data.drop()
            raise ValueError(f"{y} has too many values for {objective}")
    outputs = len(classes) if objective == "multiclass" else 1
    if objective == "regression":
        rows = F.col("_n") if data.summed else F.lit(1.0)
        base = [data.table.agg(F.try_divide(F.sum(rows * F.col("_y")), F.sum(rows))).first()[0] or 0.0]
    elif len(classes) < 2:
        data.drop()
        return TreeModel(tuple(x), (), (), (0.0,), tuple(classes or [0.0]))
    else:
        share = np.array([counts[c] for c in classes]) / data.rows
        base = [math.log(share[1] / share[0])] if outputs == 1 else np.log(share).tolist()
    averaged = boosting_type == "rf"
    if averaged:
        base = [0.0] if objective == "regression" else [-0.5] if outputs == 1 else [0.0] * outputs
    boost = _Boosting(data, objective, np.array(classes), np.array(base, float), dict(
        leaves=num_leaves if num_leaves and num_leaves > 1 else None, depth=max_depth if max_depth and max_depth > 0 else None),
        ht.Rule("newton", min_data_in_leaf, min_sum_hessian_in_leaf, lambda_l2), seed, feature_fraction, bagging_fraction)
    try:
        if averaged:
            boost.side_by_side(int(num_boost_round))
        else:
            for r in range(int(num_boost_round)):
                boost.round(r, boosting_type, learning_rate, top_rate, other_rate, drop_rate, max_drop, skip_drop)
    finally:
        boost.drop()
    return TreeModel(tuple(x), tuple(ht.in_values(t, data.cuts) for t in boost.trees), tuple(float(w) for w in boost.weights), tuple(map(float, base)), tuple(classes))


class _Boosting:
    """Trees so far, and the scores of the rows as of the last written table."""

    def __init__(self, data, objective: str, classes: np.ndarray, base: np.ndarray, size: dict, rule, seed: int, feature_fraction: float, bagging_fraction: float):
        self.data, self.objective, self.classes, self.base, self.size, self.rule, self.seed = data, objective, classes, base, size, rule, seed
        self.outputs, self.bagging = len(base), bagging_fraction
        self.per_tree = max(1, math.ceil(feature_fraction * len(data.cuts)))
        self.trees: list = []
        self.weights: list[float] = []
        self.table, self.settled = data.table, 0

    def drop(self) -> None:
        if self.table is not self.data.table:
            discard(self.table)
        self.data.drop()

    def raw(self, left_out: set[int] = frozenset()):
        """A function from a task's columns to the scores (rows, outputs); rounds in ``left_out`` don't count."""
        trees, weights, k, base = self.trees, self.weights, self.outputs, self.base
        start = 0 if left_out else self.settled
        written = start > 0

        def scores(cols, own):
            if "_scores" not in cols:
                out = np.column_stack([cols[f"_s{i}"] for i in range(k)]) if written else np.tile(base, (len(own), 1))
                for i in range(start, len(trees)):
                    if i // k not in left_out:
                        out[:, i % k] += weights[i] * ht.walk(trees[i], own)
                cols["_scores"] = out
            return cols["_scores"]

        return scores

    def gradients(self, scores):
        """A function from a task's columns to gradients and curvatures (rows, outputs)."""
        objective, classes, k = self.objective, self.classes, self.outputs

        def both(cols, own):
            if "_slopes" not in cols:
                s, y = scores(cols, own), cols["_y"]
                if objective == "regression":
                    cols["_slopes"] = s - y[:, None], np.ones_like(s)
                elif k == 1:
                    p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
                    cols["_slopes"] = p - (y == classes[1])[:, None], p * (1 - p)
                else:
                    e = np.exp(s - s.max(axis=1, keepdims=True))
                    p = e / e.sum(axis=1, keepdims=True)
                    cols["_slopes"] = p - (y[:, None] == classes[None, :]), p * (1 - p) * (k / (k - 1))
            return cols["_slopes"]

        return both

    def features(self, first: int):
        p = len(self.data.cuts)
        if self.per_tree == p:
            return None
        some = _some(self.seed, p, self.per_tree)
        return lambda tree, node: some(first + tree, 0)

    def round(self, r: int, kind: str, rate: float, top_rate: float, other_rate: float, drop_rate: float, max_drop: int, skip_drop: float) -> None:
        rng = np.random.default_rng([self.seed, r])
        left_out: set[int] = set()
        if kind == "dart" and r and rng.random() >= skip_drop:
            left_out = set(np.flatnonzero(rng.random(r) < drop_rate)[:max_drop].tolist()) or {int(rng.integers(r))}
        slopes = self.gradients(self.raw(left_out))
        bagging, high = self.bagging, None
        if kind == "goss":
            high = self._high(slopes, top_rate)

        def statistics(cols, own, tree):
            g, h = slopes(cols, own)
            weight = np.ones(len(own))
            if "_n" in cols:
                return cols["_n"], cols["_n"] * g[:, tree], cols["_n"] * h[:, tree]
            if high is not None:
                small = np.abs(g * h).sum(axis=1) < high
                weight[small] = np.where(ht.uniform(cols["_r"][small], r) < other_rate / (1 - top_rate), (1 - top_rate) / other_rate, 0.0)
            elif bagging < 1:
                weight = (ht.uniform(cols["_r"], r) < bagging).astype(float)
            return (weight > 0).astype(float), weight * g[:, tree], weight * h[:, tree]

        self.trees += ht.grow(self.data, self.table, self.outputs, self.rule, statistics, features=self.features(r * self.outputs), **self.size)
        gone = len(left_out)
        for t in left_out:
            for i in range(t * self.outputs, (t + 1) * self.outputs):
                self.weights[i] *= gone / (gone + 1)
        self.weights += [rate / (gone + 1)] * self.outputs
        if kind != "dart" and len(self.trees) - self.settled >= ht.SETTLED_TREES * self.outputs:
            self._settle()

    def _high(self, slopes, top_rate: float) -> float:
        """The gradient size that ``top_rate`` of the rows reach."""
        names, p = self.table.columns, len(self.data.cuts)

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
                g, h = slopes(cols, np.column_stack([cols[f"_b{i}"] for i in range(p)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.abs(g * h).sum(axis=1))], names=["m"])

        return self.table.mapInArrow(sizes, "m double").agg(F.percentile_approx("m", 1 - top_rate, 100_000)).first()[0]

    def _settle(self) -> None:
        """Write the scores, so that a pass walks the latest trees only."""
        scores, names, p, k = self.raw(), self.table.columns, len(self.data.cuts), self.outputs
        kept = [n for n in names if not n.startswith("_s")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
                s = scores(cols, np.column_stack([cols[f"_b{i}"] for i in range(p)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[b.column(names.index(n)) for n in kept], *[pa.array(s[:, i]) for i in range(k)]], names=[*kept, *[f"_s{i}" for i in range(k)]])

        schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in self.table.schema.fields if f.name in kept], *[f"_s{i} double" for i in range(k)]])
        old, self.table, self.settled = self.table, stable(self.table.mapInArrow(run, schema)), len(self.trees)
        if old is not self.data.table:
            discard(old)

    def side_by_side(self, rounds: int) -> None:
        """Trees for the label, or for each class against the others, on a sample each; their mean counts."""
        classes, k, bagging = self.classes, self.outputs, self.bagging

        def statistics(cols, own, tree):
            y = cols["_y"] if not len(classes) else (cols["_y"] == classes[1 if k == 1 else tree % k]).astype(float)
            weight = (ht.uniform(cols["_r"], tree // k) < bagging).astype(float) if bagging < 1 else np.ones(len(own))
            return weight, -weight * y, weight

        self.trees = ht.grow(self.data, self.table, rounds * k, self.rule, statistics, features=self.features(0), **self.size)
        self.weights = [1 / rounds] * (rounds * k)


def k_means(df: DataFrame, columns: Sequence[str], k: int, seed: int = 0, max_iter: int = 50,
            out: str = "cluster") -> DataFrame:
    """Append the cluster number of every row."""
    require_numeric(df, columns)
    fitted = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol=out)
    model = fitted.fit(_ready(df, columns))
    vec = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep")
    done = model.transform(vec.transform(df)).drop("_features")
    return done.withColumn(out, F.col(out).cast("int"))
