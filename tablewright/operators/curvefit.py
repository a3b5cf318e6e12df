"""Non-linear curve fits: exponential, logarithmic and Weibull.

Rows of equal x are first summed up as one point: their number, the mean of y and the squares
around it. That is one pass over the input, loses nothing a least squares fit needs, and is
written as a table that all steps read. A step needs sums of squares and cross-products of the
Jacobian only. A series of more points than a task should hold gets them from one Spark
aggregate per Levenberg-Marquardt step; all others are fitted side by side, each inside the
task that holds its points, by the same steps. ``converged`` says whether a fit came to rest
within its steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.core.layout import as_names, row_index, running_sum
from tablewright.core.session import GROUP_LIMIT, stable
from tablewright.core.types import quoted, require_columns, require_numeric
from tablewright.operators.models import ExponentialModel, LogarithmModel, WeibullModel


class FitError(ValueError):
    """A fit did not converge or its input overflows."""


@dataclass(frozen=True)
class Curve:
    """A model as numpy and as Spark expressions: value and derivatives at x for scale k."""

    params: tuple[str, ...]
    numpy: Callable
    spark: Callable


def _exp_numpy(p, x, k):
    a, b, c = p
    e = np.exp(-b * x)
    return a * e + c, [e, -a * x * e, np.ones_like(x)]


def _exp_spark(p, x, k):
    a, b, c = p
    e = F.exp(-b * x)
    return a * e + c, [e, -a * x * e, F.lit(1.0)]


def _weibull_numpy(p, t, k):
    m, a = p
    tm, lt = t**m, np.log(t)
    f = k * m * a * t ** (m - 1) * np.exp(-a * tm)
    return f, [f * (1 / m + lt - a * tm * lt), f * (1 / a - tm)]


def _weibull_spark(p, t, k):
    m, a = p
    tm, lt = F.pow(t, m), F.ln(t)
    f = k * m * a * F.pow(t, m - 1) * F.exp(-a * tm)
    return f, [f * (1 / m + lt - a * tm * lt), f * (1 / a - tm)]


EXPONENTIAL = Curve(("a", "b", "c"), _exp_numpy, _exp_spark)
WEIBULL = Curve(("m", "a"), _weibull_numpy, _weibull_spark)


class _Descent:
    """Levenberg-Marquardt state of one series; moments come from outside."""

    def __init__(self, guess: Sequence[float]):
        self.best = np.array(guess, dtype=float)
        self.damp, self.done, self.fit = 1e-3, False, None
        self.trial = self.best

    def offer(self, sse: float, jtj: np.ndarray, jtr: np.ndarray) -> None:
        """Take the moments at the trial point and choose the next one."""
        ok = np.isfinite(sse) and np.all(np.isfinite(jtj)) and np.all(np.isfinite(jtr))
        if self.fit is None:
            if not ok:
                raise FitError("the starting point overflows: scale the input or change the guess")
            self.fit = (sse, jtj, jtr)
        elif ok and sse <= self.fit[0]:
            gain = self.fit[0] - sse
            move = np.linalg.norm(self.trial - self.best)
            small = move <= 1e-10 * (1e-10 + np.linalg.norm(self.trial))
            self.done = small or gain <= 1e-14 * max(sse, 1e-300) or sse < 1e-28
            self.best, self.fit = self.trial, (sse, jtj, jtr)
            self.damp = max(self.damp / 10, 1e-12)
        else:
            self.damp *= 10
            self.done = self.damp > 1e12
        if not self.done:
            _, a, g = self.fit
            lhs = a + self.damp * np.diag(np.maximum(np.diag(a), 1e-30))
            self.trial = self.best + np.linalg.lstsq(lhs, g, rcond=None)[0]


def _points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and x: number of rows, mean and sum of y, squares around the mean."""
    return stable(rows.groupBy(*keys, "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sum"), F.avg("_y").alias("_mean"),
        (F.var_pop("_y") * F.count(F.lit(1))).alias("_within")))


def _fit_arrays(curve: Curve, x, y, n, within: float, k, guess, max_iter: int) -> _Descent:
    d = _Descent(guess)
    for _ in range(max_iter):
        with np.errstate(all="ignore"):
            f, j = curve.numpy(d.trial, x, k)
            r, jac = y - f, np.column_stack(j)
            d.offer(float(n @ (r * r)) + within, jac.T @ (jac * n[:, None]), jac.T @ (n * r))
        if d.done:
            break
    return d


def _fit_distributed(curve: Curve, points: DataFrame, keys: list[str], starts: dict, scales: dict,
                     max_iter: int) -> dict:
    """Fit every group of ``points``; one aggregate per step for all of them."""
    spark, q = points.sparkSession, len(curve.params)
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    state = {g: _Descent(p) for g, p in starts.items()}
    for _ in range(max_iter):
        live = [g for g, d in state.items() if not d.done]
        if not live:
            break
        schema = ", ".join([f"`_g_{c}` {types[c]}" for c in keys]
                           + [f"_p{i} double" for i in range(q)] + ["_k double"])
        table = spark.createDataFrame(
            [(*g, *map(float, state[g].trial), float(scales[g])) for g in live], schema)
        cond = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in keys]
        at = points.join(F.broadcast(table), cond)  # one row per long series
        p, k = [F.col(f"_p{i}") for i in range(q)], F.col("_k")
        f, j = curve.spark(p, F.col("_x"), k)
        at = at.select(*keys, "_n", "_within", (F.col("_mean") - f).alias("_r"),
                       *[c.alias(f"_j{i}") for i, c in enumerate(j)])
        aggs = [F.sum(F.col("_n") * F.col("_r") * F.col("_r") + F.col("_within")).alias("sse")]
        aggs += [F.sum(F.col("_n") * F.col(f"_j{i}") * F.col("_r")).alias(f"g{i}") for i in range(q)]
        aggs += [F.sum(F.col("_n") * F.col(f"_j{i}") * F.col(f"_j{h}")).alias(f"h{i}_{h}")
                 for i in range(q) for h in range(i, q)]
        for row in at.groupBy(*keys).agg(*aggs).collect():
            jtj = np.zeros((q, q))
            for i in range(q):
                for h in range(i, q):
                    jtj[i, h] = jtj[h, i] = row[f"h{i}_{h}"]
            g = tuple(row[c] for c in keys)
            state[g].offer(row["sse"], jtj, np.array([row[f"g{i}"] for i in range(q)]))
    return state


def _fit(curve: Curve, rows: DataFrame, keys: list[str], guesses: Callable[[tuple], Sequence[float]],
         limit: int, max_iter: int) -> DataFrame:
    """Parameters per group: keys, params, k, n, sse, converged."""
    spark = rows.sparkSession
    tail = ", ".join([f"`{p}` double" for p in curve.params] + ["k double", "n long", "sse double", "converged boolean"])
    if not keys:
        one = _fit(curve, rows.withColumn("_all", F.lit(0)), ["_all"], lambda _: guesses(()), limit, max_iter)
        try:
            fit = one.drop("_all").first()
        except PythonException as e:
            raise FitError(e.getMessage()) from e
        if fit is None:
            raise FitError("no rows to fit")
        return spark.createDataFrame([tuple(fit)], tail)
    key_fields = [rows.schema[c] for c in keys]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields] + [tail])
    points = _points(rows, keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.sum("_n").alias("n"), F.sum("_sum").alias("k"))
    # Series of more points than the limit are few: at most rows / limit of them.
    names = {tuple(r[c] for c in keys): r for r in sizes.where(F.col("points") > limit).collect()}

    def fit_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, n = [pdf[c].to_numpy(float) for c in ("_x", "_mean", "_n")]
        k, within = float(pdf["_sum"].sum()), float(pdf["_within"].sum())
        d = _fit_arrays(curve, x, y, n, within, k, guesses(tuple(key)), max_iter)
        return pd.DataFrame([[*key, *d.best, k, int(n.sum()), d.fit[0], bool(d.done)]],
                            columns=[*keys, *curve.params, "k", "n", "sse", "converged"])

    if not names:
        return points.groupBy(*keys).applyInPandas(fit_one, out_schema)
    kinds = ", ".join(f"`_b_{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    table = F.broadcast(spark.createDataFrame([tuple(g) for g in names], kinds))
    cond = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys]
    fits = _fit_distributed(curve, points.join(table, cond, "left_semi"), keys, {g: guesses(g) for g in names},
                            {g: r["k"] for g, r in names.items()}, max_iter)
    long = spark.createDataFrame(
        [(*g, *map(float, d.best), float(names[g]["k"]), int(names[g]["n"]), float(d.fit[0]), bool(d.done))
         for g, d in fits.items()], out_schema)
    short = points.join(table, cond, "left_anti").groupBy(*keys).applyInPandas(fit_one, out_schema)
    return long.unionByName(short)


def fit_exponential(df: DataFrame, x: str, y: str, guess: Sequence[float] = (1.0, 2.0, 3.0), by=None,
                    limit: int = GROUP_LIMIT, max_iter: int = 200) -> DataFrame:
    """Least squares of y = a * exp(-b * x) + c from a starting guess; a, b, c per group."""
    keys = as_names(by)
    require_numeric(df, [x, y])
    rows = df.select(*keys, quoted(x).cast("double").alias("_x"), quoted(y).cast("double").alias("_y"))
    start = tuple(float(v) for v in guess)
    return _fit(EXPONENTIAL, rows.na.drop(subset=["_x", "_y"]), keys, lambda _: start, limit, max_iter)


def exponential_model(params: DataFrame, x: str) -> ExponentialModel:
    r = params.first()
    return ExponentialModel(x, r["a"], r["b"], r["c"])


def fit_logarithm(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Least squares of y = a + b * log10(x): exact, one pass, any number of groups."""
    keys = as_names(by)
    require_numeric(df, [x, y])
    lx, yy = F.log10(quoted(x).cast("double")), quoted(y).cast("double")
    aggs = [F.regr_intercept(yy, lx).alias("a"), F.regr_slope(yy, lx).alias("b"),
            F.regr_count(yy, lx).alias("n")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def logarithm_model(params: DataFrame, x: str) -> LogarithmModel:
    r = params.first()
    return LogarithmModel(x, r["a"], r["b"])


def predict_grouped(df: DataFrame, params: DataFrame, by, x: str, kind: str,
                    out: str = "prediction") -> DataFrame:
    """Apply per-group exponential or logarithm parameters."""
    keys = as_names(by)
    names = {"exponential": ("a", "b", "c"), "logarithm": ("a", "b")}[kind]
    small = params.select(*[quoted(k).alias(f"_g_{k}") for k in keys],
                          *[quoted(p).alias(f"_p_{p}") for p in names])
    joined = df.join(small, [quoted(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], "left")
    v, p = quoted(x).cast("double"), {n: F.col(f"_p_{n}") for n in names}
    if kind == "exponential":
        value = p["a"] * F.exp(-p["b"] * v) + p["c"]
    else:
        value = p["a"] + p["b"] * F.log10(v)
    return joined.select(*[quoted(c) for c in df.columns], value.alias(out))


def fit_weibull(df: DataFrame, y: str, order_by, regions: Sequence[tuple[int, int]] | None = None,
                guess: Sequence[Sequence[float]] = ((1.0, 0.1),), by=None,
                limit: int = GROUP_LIMIT, max_iter: int = 500) -> DataFrame:
    """Least squares of y_t = k * m * a * t^(m-1) * exp(-a * t^m), k the sum of y.

    ``t`` counts rows from 1 in ``order_by``. ``regions`` are 1-based inclusive
    row ranges, one peak each with its own guess and its own count from 1.
    """
    keys = as_names(by)
    require_numeric(df, [y])
    if regions is not None and len(regions) != len(guess):
        raise ValueError(f"{len(regions)} regions for {len(guess)} guesses")
    rows = row_index(df, order_by, by=by, name="_i")
    if regions is None:
        peaks = F.array(F.struct(F.lit(1).alias("peak"), F.lit(1).cast("long").alias("lo")))
    else:
        hits = [F.when(F.col("_i").between(lo, hi),
                       F.struct(F.lit(p).alias("peak"), F.lit(lo).cast("long").alias("lo")))
                for p, (lo, hi) in enumerate(regions, start=1)]
        peaks = F.array_compact(F.array(*hits))
    rows = rows.withColumn("_s", F.explode(peaks)).select(
        *keys, F.col("_s.peak").alias("peak"),
        (F.col("_i") - F.col("_s.lo") + 1).cast("double").alias("_x"),
        quoted(y).cast("double").alias("_y"))
    starts = {p: tuple(float(v) for v in g) for p, g in enumerate(guess, start=1)}
    return _fit(WEIBULL, rows.na.drop(subset=["_x", "_y"]), [*keys, "peak"],
                lambda g: starts[int(g[-1])], limit, max_iter)


def weibull_model(params: DataFrame) -> WeibullModel:
    """Model of an ungrouped fit; one row per peak."""
    rows = params.orderBy("peak").collect()
    return WeibullModel(tuple(r["m"] for r in rows), tuple(r["a"] for r in rows))


def weibull_curve(costs: DataFrame, model: WeibullModel | DataFrame, peak: str = "peak") -> DataFrame:
    """Curve (a, b): peak after peak, t = 1..time, b = cost * density rounded to 5.

    ``costs`` has (peak, time, total_cost). ``peak`` may be left out for one peak.
    ``model`` is a fitted model or the parameter table of an ungrouped fit.
    """
    require_columns(costs, ["time", "total_cost"])
    spark = costs.sparkSession
    if peak not in costs.columns:
        costs = costs.withColumn(peak, F.lit(1))
    if isinstance(model, WeibullModel):
        params = spark.createDataFrame(
            [(i, m, a) for i, (m, a) in enumerate(zip(model.m, model.a), start=1)],
            "_peak int, _m double, _a double")
    else:
        params = model.select(F.col("peak").alias("_peak"), F.col("m").alias("_m"), F.col("a").alias("_a"))
    used = costs.join(params, quoted(peak) == F.col("_peak"), "left")
    lacking = F.raise_error(F.concat(F.lit("no parameters for peak "), quoted(peak).cast("string"))).cast("double")
    used = used.withColumn("_m", F.when(F.col("_peak").isNull(), lacking).otherwise(F.col("_m")))
    placed = running_sum(used.withColumn("_len", F.col("time").cast("long")), {"_upto": "_len"}, peak)
    placed = placed.withColumn("_skip", F.col("_upto") - F.col("_len"))
    steps = placed.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("time").cast("int"))))
    t = F.col("_t").cast("double")
    return steps.select((F.col("_skip") + F.col("_t")).cast("long").alias("a"),
                        F.round(weibull_density(t, F.col("total_cost"), F.col("_m"), F.col("_a")), 5).alias("b"))


def weibull_density(t: Column, k: Column, m: Column, a: Column) -> Column:
    return k * (m * a * F.pow(t, m - 1) * F.exp(-a * F.pow(t, m)))
