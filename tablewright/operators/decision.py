"""Multi-criteria decisions: CRITIC weights, TOPSIS and grey relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablewright.core.types import quoted, require_columns, require_numeric
from tablewright.operators.kendall import BLOCK_ROWS, kendall_matrix
from tablewright.operators.prep import fit_min_max
from tablewright.operators.relational import rank_by_score


def _critic(df: DataFrame, columns: Sequence[str], block_rows: int):
    require_numeric(df, columns)
    std = df.agg(*[F.stddev_samp(quoted(c)) for c in columns]).first()
    variability = np.round(np.array([0.0 if v is None else v for v in std], dtype=float), 3)
    conflict = np.round((1 - kendall_matrix(df, columns, block_rows)).sum(axis=1), 3)
    information = variability * conflict
    return variability, conflict, information


def critic(df: DataFrame, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(feature, variability, conflict, information, weight_pct) per column."""
    v, c, info = _critic(df, columns, block_rows)
    weight = np.round(info / info.sum() * 100, 2)
    rows = [(n, float(v[i]), float(c[i]), float(info[i]), float(weight[i])) for i, n in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, variability double, conflict double, information double, weight_pct double")


def critic_topsis(df: DataFrame, columns: Sequence[str], id: str,
                  block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """Tables topsis_matrix, best_result and ideal_solutions under CRITIC weights.

    Closeness is rounded to 3 digits before ranking; ties rank in ``id`` order.
    """
    require_columns(df, [id])
    columns = list(columns)
    _, _, info = _critic(df, columns, block_rows)
    weight = np.round(info / info.sum(), 5)
    if not np.all(np.isfinite(weight)):
        raise ValueError("weights are not defined: every column is constant or fully concordant")
    bounds = fit_min_max(df, columns)
    # weights are not negative, so weighted bounds come from the plain ones
    best = {c: bounds[c][1] * float(w) for c, w in zip(columns, weight)}
    worst = {c: bounds[c][0] * float(w) for c, w in zip(columns, weight)}
    weighted = {c: quoted(c).cast("double") * F.lit(float(w)) for c, w in zip(columns, weight)}

    def distance(to: Mapping[str, float]):
        return F.sqrt(reduce(lambda a, b: a + b, [(weighted[c] - F.lit(to[c])) * (weighted[c] - F.lit(to[c]))
                                                  for c in columns]))

    gaps = df.select(quoted(id), distance(best).alias("p"), distance(worst).alias("m"))
    closeness = F.try_divide(F.col("m"), F.col("p") + F.col("m"))
    scored = gaps.select(quoted(id), F.round("p", 3).alias("d_plus"), F.round("m", 3).alias("d_minus"),
                         F.round(closeness, 3).alias("closeness"))
    spark = df.sparkSession
    top = scored.orderBy(F.col("closeness").desc_nulls_last(), id).limit(1)
    return {
        "topsis_matrix": rank_by_score(scored, "closeness", id),
        "best_result": top.withColumn("ranking", F.lit(1).cast("long")),
        "ideal_solutions": spark.createDataFrame(
            [(c, best[c], worst[c]) for c in columns], "feature string, a_plus double, a_minus double"),
    }


def grey_relation(df: DataFrame, id: str, weights: Mapping[str, float], rho: float = 0.5) -> dict[str, DataFrame]:
    """Tables grey_matrix_ranking and score_matrix against the per-column maximum.

    After min-max scaling the reference value of every column is 1, the least
    difference 0 and the largest 1.
    """
    columns = list(weights)
    bounds = fit_min_max(df, columns)
    flat = [c for c, (lo, hi) in bounds.items() if lo == hi]
    if flat:
        raise ValueError(f"columns {flat} are constant")
    coef = {}
    for c in columns:
        lo, hi = bounds[c]
        delta = 1 - (quoted(c).cast("double") - F.lit(lo)) / F.lit(hi - lo)
        coef[c] = F.lit(float(rho)) / (delta + F.lit(float(rho)))
    degree = reduce(lambda a, b: a + b, [coef[c] * F.lit(float(weights[c])) for c in columns])
    ranked = rank_by_score(df.select(quoted(id), degree.alias("_g")), "_g", id)
    score = reduce(lambda a, b: a + b, [F.avg(coef[c]) * F.lit(float(weights[c])) for c in columns])
    return {
        "grey_matrix_ranking": ranked.select("ranking", quoted(id), F.round("_g", 3).alias("degree")),
        "score_matrix": df.agg((score / len(columns)).alias("score")),
    }


def kpi_score(df: DataFrame, columns: Sequence[str], id: str, method: str,
              weights: Mapping[str, float] | None = None) -> DataFrame:
    """Single score of a KPI table: TOPSIS closeness of the best row or the grey score."""
    if method == "critic_topsis":
        best = critic_topsis(df, columns, id)["best_result"]
        return best.select(F.col("closeness").alias("result"))
    if method == "grey_relation":
        return grey_relation(df, id, weights)["score_matrix"].select(F.col("score").alias("result"))
    raise ValueError(f"unknown method {method!r}")
