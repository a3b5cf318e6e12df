"""Confidence limits, principal components, factors and sensitivity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.core.gram import Moments, moments
from tablewright.core.numeric import chi2_sf, fix_signs, varimax
from tablewright.core.types import quoted, require_numeric


def confidence_levels() -> list[float]:
    """The 19 levels 0.05, 0.10, ..., 0.95."""
    return [i / 20 for i in range(1, 20)]


def ci_table(df: DataFrame, col: str | None = None) -> DataFrame:
    """(ci, value): upper end mean + z * s / sqrt(n) of the two-sided interval, of the last column by default."""
    col = col or df.columns[-1]
    require_numeric(df, [col])
    one = df.agg(F.avg(quoted(col)).alias("m"), F.stddev_samp(quoted(col)).alias("s"),
                 F.count(quoted(col)).alias("n"))
    z = {c: NormalDist().inv_cdf((1 + c) / 2) for c in confidence_levels()}
    rows = [F.struct(F.lit(c).alias("ci"),
                     (F.col("m") + F.lit(v) * F.col("s") / F.sqrt("n")).alias("value")) for c, v in z.items()]
    return one.select(F.inline(F.array(*rows)))


class _Components:
    """Everything the PCA and factor tables need, from one pass of moments."""

    def __init__(self, m: Moments, rotate: bool):
        self.names = m.columns
        self.n, self.p = m.n, len(m.columns)
        self.r = m.correlation()
        if not np.all(np.isfinite(self.r)):
            raise ValueError("a column is constant")
        self.eig = np.sort(np.linalg.eigvalsh(np.round(self.r, 3)))[::-1]
        self.k = int((self.eig > 1).sum())
        values, vectors = np.linalg.eigh(self.r)
        top = np.argsort(values)[::-1][: self.k]
        self.plain = fix_signs(vectors[:, top]) * np.sqrt(np.maximum(values[top], 0))
        self.loadings = self.plain
        if rotate and self.k > 1:
            turned = varimax(self.plain)
            order = np.argsort(-(turned**2).sum(axis=0))
            self.loadings = fix_signs(turned[:, order])

    def factor_names(self) -> list[str]:
        return [f"component_{i + 1}" for i in range(self.k)]

    @staticmethod
    def variance(loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ss = (loadings**2).sum(axis=0)
        share = ss / len(loadings)
        return ss, share, np.cumsum(share)

    def kmo(self) -> list[tuple]:
        inv = np.linalg.pinv(self.r)
        d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
        partial = -inv / d
        off = ~np.eye(self.p, dtype=bool)
        r2, q2 = (self.r[off] ** 2).sum(), (partial[off] ** 2).sum()
        sign, logdet = np.linalg.slogdet(self.r)
        chi = -(self.n - 1 - (2 * self.p + 5) / 6) * (logdet if sign > 0 else -math.inf)
        pval = chi2_sf(chi, self.p * (self.p - 1) / 2)
        return [(round(float(r2 / (r2 + q2)), 3), round(float(chi), 3), round(float(pval), 3))]

    def eigen_columns(self) -> tuple[np.ndarray, np.ndarray]:
        share = np.round(self.eig / self.eig.sum() * 100, 3)
        return share, np.cumsum(share)

    def liner(self) -> list[tuple]:
        ss, share, total = self.variance(self.loadings)
        if self.k == 0:
            return []
        coef = np.round(self.loadings / np.sqrt(ss), 4)
        score = (coef * share).sum(axis=1) / total[-1]
        weight = np.round(score / score.sum() * 100, 2)
        return [(c, *map(float, coef[i]), float(score[i]), float(weight[i])) for i, c in enumerate(self.names)]


def _table(spark: SparkSession, rows: list[tuple], names: Sequence[str], text: int = 0) -> DataFrame:
    types = ["string"] * text + ["double"] * (len(names) - text)
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
    clean = [tuple(v if v is None or isinstance(v, str) else float(v) for v in r) for r in rows]
    return spark.createDataFrame(clean, schema)


def _common_tables(spark: SparkSession, c: _Components) -> dict[str, DataFrame]:
    f = c.factor_names()
    communality = (c.loadings**2).sum(axis=1)
    load = [(n, *map(float, np.round(c.loadings[i], 3)), float(communality[i])) for i, n in enumerate(c.names)]
    return {
        "kmo": _table(spark, c.kmo(), ["kmo", "bartlett_chi2", "bartlett_p"]),
        "loading_table": _table(spark, load, ["feature", *f, "communality"], 1),
        "liner_table": _table(spark, c.liner(), ["feature", *f, "score", "weight_pct"], 1),
        "eigenvalue": _table(spark, [(i + 1, round(float(v), 3)) for i, v in enumerate(c.eig)], ["x", "y"]),
    }


def pca_analyze(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Tables kmo, variance_table, loading_table, liner_table and eigenvalue.

    Components are the eigenvalues above 1 of the correlations rounded to 3 digits.
    """
    c = _Components(moments(df, columns), rotate=False)
    share, total = c.eigen_columns()
    rows = []
    for i, v in enumerate(c.eig):
        kept = (v, share[i], total[i]) if i < c.k else (None, None, None)
        rows.append((v, share[i], total[i], *kept))
    names = ["eigenvalue", "variance_pct", "cumulative_pct",
             "component_eigenvalue", "component_variance_pct", "component_cumulative_pct"]
    spark = df.sparkSession
    return {**_common_tables(spark, c), "variance_table": _table(spark, rows, names)}


def factor_analyze(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """As ``pca_analyze`` with varimax rotation, plus component_table (scores R^-1 * loadings)."""
    c = _Components(moments(df, columns), rotate=True)
    share, total = c.eigen_columns()
    plain = [np.round(v * s, 3) for v, s in zip(c.variance(c.plain), (1, 100, 100))]
    turned = [np.round(v * s, 3) for v, s in zip(c.variance(c.loadings), (1, 100, 100))]
    rows = []
    for i, v in enumerate(c.eig):
        blocks = [b[i] if i < c.k else None for b in (*plain, *turned)]
        rows.append((v, share[i], total[i], *blocks))
    names = ["eigenvalue", "variance_pct", "cumulative_pct",
             "unrotated_eigenvalue", "unrotated_variance_pct", "unrotated_cumulative_pct",
             "rotated_eigenvalue", "rotated_variance_pct", "rotated_cumulative_pct"]
    weights = np.round(np.linalg.inv(c.r) @ c.loadings, 3)
    comp = [(n, *map(float, weights[i])) for i, n in enumerate(c.names)]
    spark = df.sparkSession
    return {
        **_common_tables(spark, c),
        "variance_table": _table(spark, rows, names),
        "component_table": _table(spark, comp, ["feature", *c.factor_names()], 1),
    }


def spread_points(spark: SparkSession, n: int, columns: int) -> tuple[DataFrame, list[Column]]:
    """``n`` evenly spread points of the unit cube: multiples of fixed irrational steps.

    Point i depends on i only, so any task can make its share of any number of points.
    """
    g = 2.0
    for _ in range(64):
        g = (1 + g) ** (1.0 / (columns + 1))
    steps = [(1 / g) ** (j + 1) % 1.0 for j in range(columns)]
    x = [F.lit(0.5) + F.col("id").cast("double") * F.lit(s) for s in steps]
    return spark.range(1, n + 1), [v - F.floor(v) for v in x]


def sobol(spark: SparkSession, model, bounds: Mapping[str, tuple[float, float]], n: int = 1000) -> DataFrame:
    """(name, value): first-order sensitivity of a model's prediction to each feature.

    Pairs of sample points A and B are drawn; AB_i is A with feature i from B.
    Moments come from two passes over the predictions, whatever their number.
    """
    names = list(bounds)
    p = len(names)
    base, u = spread_points(spark, n, 2 * p)
    scale = {c: (float(lo), float(hi) - float(lo)) for c, (lo, hi) in bounds.items()}

    def value(c: str, j: int) -> Column:
        return F.lit(scale[c][0]) + F.lit(scale[c][1]) * u[j]

    first, second = list(range(p)), list(range(p, 2 * p))
    designs = [first, second] + [first[:i] + [second[i]] + first[i + 1:] for i in range(p)]
    if hasattr(model, "outputs"):
        # An expression model is evaluated on all designs of a point in one row.
        cells = {(c, j): f"{c}_{j}" for i, c in enumerate(names) for j in (i, p + i)}
        rows = base.select("id", *[value(c, j).alias(name) for (c, j), name in cells.items()])
        per = rows.select("id", *[model.outputs([cells[c, j] for c, j in zip(names, d)])[0].alias(f"f{k}")
                                  for k, d in enumerate(designs)])
    else:
        points = F.array(*[F.struct(*[value(c, j).alias(c) for c, j in zip(names, d)]) for d in designs])
        rows = base.select("id", F.posexplode(points).alias("_d", "_s")).select("id", "_d", "_s.*")
        out = model.predict(rows, "_f").select("id", "_d", "_f")
        per = out.groupBy("id").agg(*[F.max(F.when(F.col("_d") == k, F.col("_f"))).alias(f"f{k}")
                                      for k in range(len(designs))])
    m = per.agg(F.avg("f0"), F.avg("f1")).first()
    mid = (m[0] + m[1]) / 2
    f0, f1 = F.col("f0") - F.lit(mid), F.col("f1") - F.lit(mid)
    var = (F.avg(f0 * f0) + F.avg(f1 * f1)) / 2
    gains = [F.avg(f1 * (F.col(f"f{i + 2}") - F.col("f0"))).alias(f"g{i}") for i in range(p)]
    one = per.agg(var.alias("v"), *gains)
    cells = [F.struct(F.lit(c).alias("name"), F.try_divide(F.col(f"g{i}"), F.col("v")).alias("value"))
             for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*cells)))
