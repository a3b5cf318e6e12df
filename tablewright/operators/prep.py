"""Scaling, transforms, feature expansion, projection and splits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import mul

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.core.gram import moments
from tablewright.core.layout import as_names
from tablewright.core.numeric import fix_signs
from tablewright.core.ranks import between, cut_at, row_digits
from tablewright.core.session import hold
from tablewright.core.types import Scaler, known, quoted, require_columns, require_numeric


def fit_min_max(df: DataFrame, columns: Sequence[str],
                manual: Mapping[str, tuple[float, float]] | None = None) -> Scaler:
    """Observed or given (min, max) per column, in one pass; NaN cells don't count."""
    require_numeric(df, columns)
    manual = dict(manual or {})
    for name, bounds in manual.items():
        if bounds[0] is None or bounds[1] is None:
            raise ValueError(f"bounds of {name} are incomplete")
    seen = [c for c in columns if c not in manual]
    row = []
    if seen:
        row = df.agg(*[f(known(c)) for c in seen for f in (F.min, F.max)]).first()
    observed = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(seen)}
    return {c: tuple(float(v) for v in (manual.get(c) or observed[c])) for c in columns}


def min_max_scale(df: DataFrame, columns: Sequence[str],
                  manual: Mapping[str, tuple[float, float]] | None = None):
    """Scale columns to (x - min) / (max - min), rounded to 10 digits.

    Returns the table and the scaler. Values outside manual bounds are not clipped.
    """
    scaler = fit_min_max(df, columns, manual)
    out = {}
    for c, (lo, hi) in scaler.items():
        if lo != hi:
            out[c] = F.round((quoted(c) - F.lit(lo)) / F.lit(hi - lo), 10)
    return (df.withColumns(out) if out else df), scaler


def inverse_min_max(df: DataFrame, columns: Sequence[str], scaler: Scaler,
                    by_name: bool = False) -> DataFrame:
    """Undo scaling; columns pair with scaler entries by position or by name."""
    require_numeric(df, columns)
    if len(columns) != len(scaler):
        raise ValueError(f"{len(columns)} columns for {len(scaler)} scaler entries")
    bounds = [scaler[c] for c in columns] if by_name else list(scaler.values())
    out = {}
    for c, (lo, hi) in zip(columns, bounds):
        if lo != hi:
            out[c] = quoted(c) * F.lit(hi - lo) + F.lit(lo)
    return df.withColumns(out) if out else df


def natural_log(col: Column) -> Column:
    """ln with -inf at zero and NaN below it."""
    col = col.cast("double")
    return (F.when(col > 0, F.ln(col)).when(col == 0, F.lit(-math.inf))
            .when(col.isNull(), F.lit(None)).otherwise(F.lit(math.nan)))


def boxcox_expression(col: Column, lam: float) -> Column:
    col = col.cast("double")
    return F.ln(col) if abs(lam) < 1e-12 else (F.pow(col, F.lit(lam)) - 1) / F.lit(lam)


def boxcox_lambda(df: DataFrame, column: str, bound: float = 5.0) -> float:
    """Maximum-likelihood lambda: a coarse grid, then parabolas through ever closer points."""
    x = quoted(column).cast("double")
    base = df.select(x.alias("x")).na.drop()
    low, high, mean_log = base.agg(F.min("x"), F.max("x"), F.avg(F.when(F.col("x") > 0, F.ln("x")))).first()
    if low is None or low <= 0:
        raise ValueError(f"{column} must be positive")
    if low == high:
        raise ValueError(f"{column} is constant")
    # Dividing by the geometric mean keeps powers near 1; it shifts the
    # likelihood by a constant only and leaves its variance term.
    u = F.col("u")
    scaled = hold(base.select((F.ln("x") - F.lit(mean_log)).alias("u")))

    def loss(points: np.ndarray) -> np.ndarray:
        spread = [F.var_pop(u if abs(g) < 1e-9 else F.exp(u * float(g)) / float(g)) for g in points]
        with np.errstate(divide="ignore"):
            return np.log(np.array(scaled.agg(*spread).first(), dtype=float))

    try:
        while True:
            grid = np.linspace(-bound, bound, 21)
            values = loss(grid)
            best = int(np.argmin(values))
            if best not in (0, 20) or bound > 100:
                break
            bound *= 3
        lam, step = float(grid[best]), float(grid[1] - grid[0])
        for width in (step, 0.1 * step, 0.01 * step, 0.004 * step):
            at = lam + width * np.array([-1.0, 0.0, 1.0])
            a, b, c = loss(at) if width != step or best in (0, 20) else values[best - 1:best + 2]
            if a - 2 * b + c > 0:
                lam += float(np.clip(width * (a - c) / (2 * (a - 2 * b + c)), -width, width))
    finally:
        scaled.unpersist()
    return lam


def column_process(df: DataFrame, plan: Mapping[str, str]):
    """Apply ``nplog`` or ``boxcox`` per column; returns the table and fitted parameters."""
    require_numeric(df, plan)
    out, params = {}, {}
    for name, kind in plan.items():
        if kind == "nplog":
            out[name] = natural_log(quoted(name))
        elif kind == "boxcox":
            params[name] = boxcox_lambda(df, name)
            out[name] = boxcox_expression(quoted(name), params[name])
        else:
            raise ValueError(f"unknown transform {kind!r}")
    return df.withColumns(out), params


def polynomial_terms(columns: Sequence[str], degree: int, interaction_only: bool) -> list[tuple]:
    pick = combinations if interaction_only else combinations_with_replacement
    return [t for d in range(1, degree + 1) for t in pick(columns, d)]


def term_name(term: Sequence[str]) -> str:
    counts: dict[str, int] = {}
    for c in term:
        counts[c] = counts.get(c, 0) + 1
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in counts.items())


def polynomial(df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2,
               interaction_only: bool = False) -> DataFrame:
    """Replace columns by all their products up to a degree, without a constant."""
    columns = list(columns or df.columns)
    require_numeric(df, columns)
    rest = [quoted(c) for c in df.columns if c not in columns]
    terms = polynomial_terms(columns, degree, interaction_only)
    made = [reduce(mul, [quoted(c).cast("double") for c in t]).alias(term_name(t)) for t in terms]
    return df.select(*rest, *made)


def pca_axes(df: DataFrame, x: Sequence[str], n_components: int):
    """Means and leading covariance eigenvectors of the features."""
    m = moments(df, x)
    values, vectors = np.linalg.eigh(m.cross / (m.n - 1))
    order = np.argsort(values)[::-1][:n_components]
    return m.mean_of(x), fix_signs(vectors[:, order]), values[order]


def pca_project(df: DataFrame, x: Sequence[str], y: Sequence[str] = (), n_components: int = 2) -> DataFrame:
    """Project centred features on principal axes ``x_1..x_n`` and keep the labels.

    Each axis is signed so that its largest loading is positive.
    """
    require_numeric(df, x)
    mean, axes, _ = pca_axes(df, x, n_components)
    scores = []
    for j in range(axes.shape[1]):
        parts = [(quoted(c) - F.lit(float(mean[i]))) * F.lit(float(axes[i, j])) for i, c in enumerate(x)]
        scores.append(reduce(lambda a, b: a + b, parts).alias(f"x_{j + 1}"))
    return df.select(*scores, *[quoted(c) for c in y])


def hash_unit(key, seed: int = 0, buckets: int = 10_000) -> Column:
    """Bucket 0..buckets-1 of a row, fixed by its key columns and the seed."""
    text = F.concat_ws(":", *[F.coalesce(quoted(c).cast("string"), F.lit("~")) for c in as_names(key)],
                       F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def data_split(df: DataFrame, key, train: int = 80, test: int = 20, valid: int = 0, seed: int = 0,
               override: Mapping[str, DataFrame] | None = None, exact: bool = False) -> dict[str, DataFrame]:
    """Split into train, test and (when asked for) valid parts by percentages.

    By default each row goes where the hash of its key falls, so the split is
    stable and needs no shuffle. ``exact`` sizes the parts by rank of the hash (equal hashes
    by a hash of the row), found from counts alone.
    ``override`` replaces computed parts with given tables; the other parts are computed.
    """
    if train + test + valid != 100:
        raise ValueError("percentages must add up to 100")
    override = dict(override or {})
    wanted = {"train", "test", *(["valid"] if valid else [])}
    if wanted <= set(override):
        return override
    names = as_names(key)
    require_columns(df, names)
    if exact:
        total = df.count()
        first = total - -(-total * (test + valid) // 100)
        digits = row_digits(df, hash_unit(names, seed, 2**31))
        cuts = [cut_at(df, digits, first), cut_at(df, digits, first + -(-total * test // 100)) if valid else None]
        parts = {"train": between(df, digits, None, cuts[0]), "test": between(df, digits, cuts[0], cuts[1])}
        if valid:
            parts["valid"] = between(df, digits, cuts[1], None)
        return parts | override
    ranked, at = df.withColumn("_at", hash_unit(names, seed, 10_000)), F.col("_at")
    cut1, cut2 = train * 100, (train + test) * 100
    parts = {
        "train": ranked.where(at < cut1),
        "test": ranked.where((at >= cut1) & (at < cut2)),
    }
    if valid:
        parts["valid"] = ranked.where(at >= cut2)
    return {k: v.drop("_at") for k, v in parts.items()} | override


def to_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Assemble numeric columns into an ML vector."""
    require_numeric(df, columns)
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def from_vector(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Spread an ML vector over named columns."""
    arr = df.withColumn("_arr", vector_to_array(quoted(vector)))
    made = {n: F.col("_arr")[i] for i, n in enumerate(names)}
    return arr.withColumns(made).drop("_arr", vector)


def kpi_rows(df: DataFrame, names: Sequence[str], name: str = "kpiName", values: str = "value") -> DataFrame:
    """Turn one row per KPI with an array of values into one column per KPI.

    Row ``pos`` of the result holds the pos-th value of every named KPI.
    """
    cells = df.select(quoted(name).alias("_k"), F.posexplode(quoted(values)).alias("pos", "_v"))
    picked = [F.max(F.when(F.col("_k") == n, F.col("_v"))).alias(n) for n in names]
    return cells.groupBy("pos").agg(*picked)


def kpi_weights(df: DataFrame, weights: DataFrame, name: str = "kpiName", feature: str = "feature",
                weight: str = "weight_pct") -> DataFrame:
    """Write each KPI's weight into ``value``; infinite weights count as 0."""
    small = weights.select(quoted(feature).alias("_f"), quoted(weight).alias("_w"))
    w = F.when(F.abs(F.col("_w")) == F.lit(math.inf), 0.0).otherwise(F.col("_w"))
    joined = df.drop("value").join(small, quoted(name) == F.col("_f"), "left")
    return joined.withColumn("value", w).drop("_f", "_w")
