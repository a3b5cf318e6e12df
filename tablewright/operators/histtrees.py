"""Regression trees, forests and boosting from histograms, grown leaf by leaf.

Features are cut into bins once and the binned table is written. A pass over it counts, for
every open node, how much of each statistic falls into each (feature, bin): tasks add up their
rows in numpy, one aggregate adds up the tasks, and a window over the bins of a feature finds
the best cut. What reaches the driver is one row a node.

Trees grow best first: of all leaves the one whose cut gains most is cut next, until the asked
number of leaves is there. A pass opens every node that the best-first order has reached with
what is known so far, so a tree takes about as many passes as it is deep, and the result is
the same as cutting one leaf at a time.

Rows with a missing feature or label are left out; equal gains go to the first feature, the
lowest cut and the oldest leaf. Samples follow a hash of the row's key, so they can be repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.core.session import discard, stable
from tablewright.core.types import quoted, require_numeric

CELLS = 4_000_000  # of the histograms of one pass in one task
LABEL_BINS = 256
SETTLED_TREES = 10  # boosted scores are written after so many trees
EXPRESSION_LEAVES = 512
_M, _STEP = (1 << 31) - 1, 48_271

#: A tree: feature, cut, left, right, value of each node; leaves have feature -1.
Tree = tuple[tuple[int, ...], tuple[float, ...], tuple[int, ...], tuple[int, ...], tuple[float, ...]]


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Value of the leaf of each row of ``x``."""
    feature, cut, left, right, value = (np.array(v) for v in tree)
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return value[at]
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])


def in_values(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """A tree over bins as one over the features' values."""
    feature, cut, left, right, value = tree
    return feature, tuple(float(cuts[f][int(c)]) if f >= 0 else 0.0 for f, c in zip(feature, cut, strict=True)), left, right, value


@dataclass(frozen=True)
class TreeModel:
    """Weighted trees, one output after the other; with ``classes`` the class of the greatest output (of two: above zero)."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    base: tuple[float, ...]  # one an output
    classes: tuple[float, ...] = ()

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base, float), (len(x), 1))
        for k, (tree, w) in enumerate(zip(self.trees, self.weights, strict=True)):
            out[:, k % len(self.base)] += w * walk(tree, x)
        return out

    def outputs(self, columns: Sequence[str] | None = None) -> list[Column]:
        """The prediction as one column: an expression, or for many leaves a function over Arrow batches; null where a feature is missing."""
        x = [quoted(c).cast("double") for c in (columns or self.features)]
        there = ~F.greatest(*[v.isNull() | F.isnan(v) for v in x], F.lit(False))
        if sum(sum(f < 0 for f in t[0]) for t in self.trees) <= EXPRESSION_LEAVES:
            raw = [F.lit(float(b)) for b in self.base]
            for k, (tree, w) in enumerate(zip(self.trees, self.weights, strict=True)):
                raw[k % len(raw)] = raw[k % len(raw)] + F.lit(float(w)) * _branch(tree, x, 0)
            if len(self.classes) == 2:
                made = F.when(raw[0] > 0, self.classes[1]).otherwise(self.classes[0])
            elif self.classes:
                top = F.greatest(*raw)
                made = F.lit(self.classes[-1])
                for c, r in reversed(list(zip(self.classes[:-1], raw[:-1], strict=True))):
                    made = F.when(r == top, c).otherwise(made)
            else:
                made = raw[0]
            return [F.when(there, made.cast("double"))]
        model = self

        @F.pandas_udf("double")
        def scored(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in rows:
                yield pd.Series(model.decide(model.raw(np.column_stack([c.to_numpy(float) for c in cols]))))

        return [F.when(there, scored(*x))]

    def decide(self, raw: np.ndarray) -> np.ndarray:
        if len(self.classes) == 2:
            return np.where(raw[:, 0] > 0, self.classes[1], self.classes[0])
        return np.array(self.classes)[raw.argmax(axis=1)] if self.classes else raw[:, 0]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.outputs()[0])


def _branch(tree: Tree, x: list[Column], at: int) -> Column:
    feature, cut, left, right, value = tree
    if feature[at] < 0:
        return F.lit(float(value[at]))
    return F.when(x[feature[at]] <= cut[at], _branch(tree, x, left[at])).otherwise(_branch(tree, x, right[at]))


@dataclass
class Binned:
    """The written table: ``_b0..`` bins, ``_y`` label, ``_l`` label bin, ``_r`` row number for samples."""

    table: DataFrame
    cuts: list[np.ndarray]
    rows: int
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # value of each label bin
    summed: bool = False  # a row a combination of bins: ``_n`` rows, ``_y`` their mean, ``_w0, _a0..`` sums of the samples

    @property
    def bins(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    def drop(self) -> None:
        discard(self.table)


def _cuts_of(rows: DataFrame, columns: list[str], most: int) -> list[np.ndarray]:
    """Cuts between neighbouring values, or at quantiles where there are more than ``most`` values."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0)] * len(columns)
        for b in batches:
            for i, own in enumerate(seen):
                if len(own) <= most:  # one more shows that they are too many
                    seen[i] = np.union1d(own, b.column(i).to_numpy())[:most + 1]
        for i, own in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own)], names=["i", "v"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            of, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in np.unique(of):
                seen[i] = np.union1d(seen.get(i, v[:0]), v[of == i])[:most + 1]
        for i, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own)], names=["i", "v"])

    values: dict[int, list[float]] = {i: [] for i in range(len(columns))}
    # Most + 1 values a column reach the driver, also of many tasks. No filter stands over the rows: for one the optimizer
    # would restate the test for missing values with every subset of the columns, 2 to the power of their number.
    for i, v in rows.select(*columns).mapInArrow(met, "i int, v double").repartition("i").mapInArrow(least, "i int, v double").collect():
        values[i].append(v)
    values = {i: v for i, v in values.items() if len(v) <= most}
    many = [i for i in range(len(columns)) if i not in values]
    shares = [k / most for k in range(1, most)]
    marks = dict(zip(many, rows.agg(*[F.percentile_approx(columns[i], shares, 5 * most) for i in many]).first(), strict=True)) if many else {}
    out = []
    for i in range(len(columns)):
        v = np.array(sorted(values.get(i, [])))
        out.append(np.unique(marks[i]) if i in marks else (v[1:] + v[:-1]) / 2)
    return out


def binned(df: DataFrame, x: Sequence[str], y: str, max_bins: int, key: Sequence[str] | None, seed: int, labels: bool = False, draws: int | None = None) -> Binned:
    """Bins of all rows; with ``draws``, where the bins have few combinations, their sums (of so many bootstrap samples, or of the rows for 0)."""
    require_numeric(df, [*x, y])
    cols = [f"_x{i}" for i in range(len(x))]
    name = F.concat_ws(":", *[F.coalesce(quoted(k).cast("string"), F.lit("~")) for k in (key or [*x, y])], F.lit(str(seed)))
    # Rows that no sample is drawn from need no number.
    row = F.lit(1).cast("long") if draws == 0 else F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % (_M - 1) + 1
    rows = df.select(*[quoted(c).cast("double").alias(n) for c, n in zip(x, cols, strict=True)], quoted(y).cast("double").alias("_y"), row.alias("_r")).na.drop()
    cuts = _cuts_of(rows, cols, max_bins)
    if draws is not None:
        summed = _cells_of(rows, cuts, draws)
        if summed is not None:
            return summed
    label_cuts = _cuts_of(rows, ["_y"], LABEL_BINS)[0] if labels else np.zeros(0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.searchsorted(c, b.column(i).to_numpy(), "left").astype(np.int16) for i, c in enumerate(cuts)]
            label = b.column(len(cuts))
            level = np.searchsorted(label_cuts, label.to_numpy(), "left").astype(np.int16)
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), label, pa.array(level), b.column(len(cuts) + 1)],
                                             names=[*[f"_b{i}" for i in range(len(cuts))], "_y", "_l", "_r"])

    schema = ", ".join([*[f"_b{i} short" for i in range(len(x))], "_y double", "_l short", "_r long"])
    table = stable(rows.mapInArrow(cut, schema))
    out = Binned(table, cuts, table.count())
    if labels:
        out.levels = np.zeros(len(label_cuts) + 1)
        for level, value in table.groupBy("_l").agg(F.avg("_y")).collect():  # at most LABEL_BINS rows
            out.levels[level] = value
    return out


def _cells_of(rows: DataFrame, cuts: list[np.ndarray], draws: int) -> Binned | None:
    """The rows summed by their combination of bins, or none when there are nearly as many combinations as rows.

    Squared errors and gradients only ask for sums, so passes over the sums give the same cuts.
    """
    sizes = [len(c) + 1 for c in cuts]
    cells, width = math.prod(sizes), 2 * (draws + 1)
    if cells * width > CELLS:
        return None
    n = rows.count()
    if cells * 8 > n:
        return None
    names = ["_n", "_t", *[f"_{c}{k}" for k in range(draws) for c in "wa"]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, cells))
        for b in batches:
            *own, y, r = [b.column(i).to_numpy() for i in range(len(cuts) + 2)]
            at = np.zeros(len(y), np.int64)
            for c, size, v in zip(cuts, sizes, own, strict=True):
                at = at * size + np.searchsorted(c, v, "left")
            met, at = np.unique(at, return_inverse=True)
            for k in range(draws + 1):
                w = np.ones(len(y)) if k == 0 else drawn(r, k - 1)
                total[2 * k, met] += np.bincount(at, w, len(met))
                total[2 * k + 1, met] += np.bincount(at, w * y, len(met))
        met = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int16)) for v in np.unravel_index(met, sizes)], *[pa.array(t[met]) for t in total]],
                                         names=[*[f"_b{i}" for i in range(len(cuts))], *names])

    bins = [f"_b{i}" for i in range(len(cuts))]
    parts = rows.mapInArrow(add, ", ".join([*[f"{b} short" for b in bins], *[f"{c} double" for c in names]]))
    table = parts.groupBy(*bins).agg(*[F.sum(c).alias(c) for c in names]).withColumn("_y", F.col("_t") / F.col("_n")).drop("_t")
    return Binned(stable(table), cuts, n, summed=True)


def uniform(rows: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each row and draw: the draw-th step of a Lehmer generator begun at the row's number."""
    return rows * pow(_STEP, draw + 1, _M) % _M / _M


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def drawn(rows: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of a tree."""
    return np.searchsorted(_POISSON, uniform(rows, tree)).astype(float)


@dataclass
class Node:
    depth: int
    stats: tuple[float, ...]  # weight, first and second statistic; for medians the median comes last
    known: bool = False
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None


class Growing:
    """One tree: nodes known so far, and the best-first order over them."""

    def __init__(self, leaves: int, depth: int, least_gain: float, least_split: float):
        self.nodes, self.leaves, self.depth, self.least_gain, self.least_split = [Node(0, ())], leaves, depth, least_gain, least_split

    def chosen(self) -> tuple[list[int], list[int]]:
        """Nodes to cut in best-first order, and the nodes that must be opened to know more."""
        picked, missing, heap = [], [], []

        def offer(k: int) -> None:
            node = self.nodes[k]
            if not node.known:
                missing.append(k)
            elif node.feature >= 0 and node.gain > 0 and node.gain >= self.least_gain:
                heapq.heappush(heap, (-node.gain, k))

        offer(0)
        while heap and len(picked) + 1 < self.leaves:
            _, k = heapq.heappop(heap)
            picked.append(k)
            if len(picked) + 1 < self.leaves:  # after the last cut nothing more is asked
                for c in self.nodes[k].children:
                    offer(c)
        return picked, missing

    def learn(self, k: int, best) -> None:
        """``best``: (gain, feature, bin, stats left, stats right), or None."""
        node = self.nodes[k]
        node.known = True
        if best is None:
            return
        node.gain, node.feature, node.bin = best[:3]
        node.children = len(self.nodes), len(self.nodes) + 1
        for stats in best[3:]:
            child = Node(node.depth + 1, stats)
            child.known = child.depth >= self.depth or stats[0] < self.least_split  # then it stays a leaf
            self.nodes.append(child)

    def finished(self, value: Callable[[tuple], float]) -> Tree:
        """The tree over bins."""
        picked, _ = self.chosen()
        cut = set(picked)
        place, order = {0: 0}, [0]
        for k in order:
            if k in cut:
                for c in self.nodes[k].children:
                    place[c] = len(order)
                    order.append(c)
        rows = [(n.feature, float(n.bin), place[n.children[0]], place[n.children[1]], 0.0) if k in cut else (-1, 0.0, -1, -1, float(value(n.stats)))
                for k, n in ((k, self.nodes[k]) for k in order)]
        return tuple(zip(*rows, strict=True))

    def routes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature, bin, left and right of every node, for walking binned rows."""
        n = [(x.feature if x.children else -1, x.bin, *(x.children or (-1, -1))) for x in self.nodes]
        return tuple(np.array(v) for v in zip(*n, strict=True))


def _home(routes, bins: np.ndarray) -> np.ndarray:
    """Node of each row: the deepest that its bins lead to."""
    feature, cut, left, right = routes
    at = np.zeros(len(bins), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = np.where(bins[inner, feature[node]] <= cut[node], left[node], right[node])


@dataclass(frozen=True)
class Rule:
    """How cuts are judged: ``newton`` (gradients and curvatures), ``squared_error``, ``poisson`` or ``absolute_error``."""

    name: str = "squared_error"
    least_leaf: float = 1
    least_weight: float = 0.0  # of the second statistic in a leaf
    shrink: float = 0.0

    def value(self, stats: tuple) -> float:
        if self.name == "newton":
            return -stats[1] / (stats[2] + self.shrink) if stats[2] + self.shrink > 0 else 0.0
        return stats[-1] if self.name == "absolute_error" else stats[1] / stats[0]

    def part(self, n: Column, a: Column, b: Column) -> Column:
        """What a set of rows adds to the gain."""
        if self.name == "newton":
            return F.when(b + self.shrink > 0, a * a / (b + self.shrink)).otherwise(0.0)
        if self.name == "poisson":
            return F.when(a > 0, a * F.ln(a / n)).otherwise(0.0)
        return a * a / n


def _best_cuts(hist: DataFrame, rule: Rule) -> dict[tuple[int, int], tuple]:
    """(tree, node) -> totals and the best cut, from rows (tree, node, feature, bin, n, a, b)."""
    w = Window.partitionBy("tree", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("tree", "node", "feature")
    # Dealt once for the sums, the windows and most of the maximum; each task has added up its rows before.
    sums = hist.repartition("tree", "node", "feature").groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "nab"])
    at = sums.select("tree", "node", "feature", "bin", *[F.sum(c).over(w).alias(f"{c}l") for c in "nab"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "nab"])
    left, total = [F.col(f"{c}l") for c in "nab"], [F.col(f"{c}t") for c in "nab"]
    right = [t - v for t, v in zip(total, left, strict=True)]
    gain = rule.part(*left) + rule.part(*right) - rule.part(*total)
    ok = (left[0] >= rule.least_leaf) & (right[0] >= rule.least_leaf) & (left[0] > 0) & (right[0] > 0)
    if rule.name == "newton":
        ok = ok & (left[2] >= rule.least_weight) & (right[2] >= rule.least_weight)
    if rule.name == "poisson":
        ok = ok & (left[1] > 0) & (right[1] > 0)
    best = F.max(F.when(ok, F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), *[v.alias(f"l{i}") for i, v in enumerate(left)])))
    rows = at.groupBy("tree", "node").agg(best.alias("best"), *[F.max(f"{c}t").alias(c) for c in "nab"]).collect()  # one a node
    out = {}
    for r in rows:
        totals, b = (r["n"], r["a"], r["b"]), r["best"]
        if b is not None:
            own = (b["l0"], b["l1"], b["l2"])
            b = (b["gain"], -b["f"], -b["b"], own, tuple(t - v for t, v in zip(totals, own, strict=True)))
        out[r["tree"], r["node"]] = totals, b
    return out


def _median_sums(counts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of rows, sum of distances to the median, and median, of each row of counts by label bin."""
    upto, total = counts.cumsum(axis=1), counts.sum(axis=1)
    low = (upto * 2 >= total[:, None]).argmax(axis=1)
    high = (upto * 2 > total[:, None]).argmax(axis=1)
    middle = (levels[low] + levels[high]) / 2
    away = (counts * np.abs(levels[None, :] - middle[:, None])).sum(axis=1)
    return total, away, middle


def _best_median_cuts(hist: DataFrame, rule: Rule, levels: np.ndarray, bins: int) -> dict[tuple[int, int], tuple]:
    """The same for distances to the median, from rows (tree, node, feature, bin, level, n)."""
    sums = hist.groupBy("tree", "node", "feature", "bin", "level").agg(F.sum("n").alias("n"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((bins, len(levels)))
        np.add.at(counts, (pdf["bin"].to_numpy(), pdf["level"].to_numpy()), pdf["n"].to_numpy())
        left = counts.cumsum(axis=0)
        n, away, middle = _median_sums(left, levels)
        m, rest, other = _median_sums(left[-1] - left, levels)
        gain = np.where((n >= max(rule.least_leaf, 1e-12)) & (m >= max(rule.least_leaf, 1e-12)), away[-1] - away - rest, -np.inf).round(9)
        k = int(gain.argmax())
        head = pdf.iloc[0]
        return pd.DataFrame([[int(head["tree"]), int(head["node"]), int(head["feature"]), k, float(gain[k]), n[k], away[k], middle[k], m[k], rest[k], other[k], n[-1], away[-1], middle[-1]]],
                            columns=names)

    names = ["tree", "node", "feature", "bin", "gain", "ln", "la", "lm", "rn", "ra", "rm", "n", "a", "m"]
    schema = "tree int, node int, feature int, bin int, " + ", ".join(f"{c} double" for c in names[4:])
    cuts = sums.groupBy("tree", "node", "feature").applyInPandas(best, schema)
    top = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), *names[5:])).alias("t")
    out = {}
    for r in cuts.groupBy("tree", "node").agg(top).collect():  # one a node
        t = r["t"]
        found = None if t["gain"] == -math.inf else (t["gain"], -t["f"], -t["b"], (t["ln"], t["la"], t["lm"]), (t["rn"], t["ra"], t["rm"]))
        out[r["tree"], r["node"]] = (t["n"], t["a"], t["m"]), found
    return out


#: What a task learns of its rows: (weight, first, second statistic) of the rows for a tree, from a table of the columns.
Statistics = Callable[[dict[str, np.ndarray], np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _histograms(data: Binned, table: DataFrame, trees: dict[int, tuple], wanted: dict[tuple[int, int], list[int]], statistics: Statistics, by_level: bool) -> DataFrame:
    """Sums of the statistics by (tree, node, feature, bin), of the wanted nodes and their features only."""
    p, bins, levels = len(data.cuts), data.bins, max(len(data.levels), 1)
    slots = {node: k for k, node in enumerate(wanted)}
    asked = np.zeros((len(wanted), p), bool)
    for node, k in slots.items():
        asked[k, wanted[node]] = True
    key = np.array(list(wanted), np.int64).reshape(-1, 2)

    def rows_of(cells: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        cells, level = (cells // levels, cells % levels) if by_level else (cells, None)
        slot, rest = cells // (p * bins), cells % (p * bins)
        cols = [pa.array(key[slot, 0].astype(np.int32)), pa.array(key[slot, 1].astype(np.int32)), pa.array((rest // bins).astype(np.int32)), pa.array((rest % bins).astype(np.int32))]
        names = ["tree", "node", "feature", "bin"]
        if by_level:
            return pa.RecordBatch.from_arrays([*cols, pa.array(level.astype(np.int32)), pa.array(sums[0])], names=[*names, "level", "n"])
        return pa.RecordBatch.from_arrays([*cols, *map(pa.array, sums)], names=[*names, "n", "a", "b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(slots) * p * bins) for _ in range(3)] if not by_level else None
        for batch in batches:
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            own = np.column_stack([cols[f"_b{i}"] for i in range(p)]).astype(np.int64)
            for tree, routes in trees.items():
                table_of = np.full(len(routes[0]), -1)
                for (t, node), k in slots.items():
                    if t == tree:
                        table_of[node] = k
                slot = table_of[_home(routes, own)]
                weight, a, b = statistics(cols, own, tree)
                here = np.flatnonzero((slot >= 0) & (weight > 0))
                for f in range(p):
                    use = here[asked[slot[here], f]]
                    cell = (slot[use] * p + f) * bins + own[use, f]
                    if by_level:
                        cell, at = np.unique(cell * levels + cols["_l"][use], return_inverse=True)
                        if len(cell):
                            yield rows_of(cell, [np.bincount(at, weight[use], len(cell))])
                    else:
                        for k, v in enumerate((weight, a, b)):
                            total[k] += np.bincount(cell, v[use], len(total[k]))
        if total is not None:
            cells = np.flatnonzero(total[0])
            yield rows_of(cells, [t[cells] for t in total])

    return table.mapInArrow(count, "tree int, node int, feature int, bin int, " + ("level int, n double" if by_level else "n double, a double, b double"))


def grow(data: Binned, table: DataFrame, count: int, rule: Rule, statistics: Statistics, *, leaves: int | None = None, depth: int | None = None, least_gain: float = 0.0,
         least_split: float = 2, features: Callable[[int, int], list[int]] | None = None) -> list[Tree]:
    """``count`` trees over bins at a time; ``features`` names those that a (tree, node) may be cut by."""
    growing = {t: Growing(leaves or 1 << 62, depth or 1 << 30, least_gain, least_split) for t in range(count)}
    everything = list(range(len(data.cuts)))
    by_level = rule.name == "absolute_error"
    size = max(1, CELLS // (len(data.cuts) * data.bins))
    while True:
        open_nodes = [(t, k) for t, g in growing.items() for k in g.chosen()[1]]
        if not open_nodes:
            break
        for s in range(0, len(open_nodes), size):
            wanted = {node: features(*node) if features else everything for node in open_nodes[s:s + size]}
            trees = {t: growing[t].routes() for t in {t for t, _ in wanted}}
            hist = _histograms(data, table, trees, wanted, statistics, by_level)
            found = _best_median_cuts(hist, rule, data.levels, data.bins) if by_level else _best_cuts(hist, rule)
            for t, k in wanted:
                totals, best = found.get((t, k), ((0.0, 0.0, 0.0), None))
                node = growing[t].nodes[k]
                node.stats = totals if k == 0 else node.stats
                growing[t].learn(k, best if totals[0] >= least_split else None)
    return [g.finished(rule.value) if g.nodes[0].stats[0] else ((-1,), (0.0,), (-1,), (-1,), (0.0,)) for g in growing.values()]
