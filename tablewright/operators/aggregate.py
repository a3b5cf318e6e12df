"""Summary aggregates over columns and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.core.layout import as_names
from tablewright.core.types import known, require_numeric


def _per_column(df: DataFrame, columns: Sequence[str], stats: Mapping[str, object]) -> DataFrame:
    """One pass over the table, then one output row per column; NaN cells don't count."""
    require_numeric(df, columns)
    one = df.agg(*[fn(known(c)).alias(f"{name}_{i}")
                   for i, c in enumerate(columns) for name, fn in stats.items()])
    rows = [F.struct(F.lit(c).alias("name"), *[F.col(f"{s}_{i}").alias(s) for s in stats])
            for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def column_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, min, max) per column."""
    as_double = {"min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    return _per_column(df, columns, as_double)


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, std, n) per column; std uses n - 1."""
    return _per_column(df, columns, {"mean": F.avg, "std": F.stddev_samp, "n": F.count})


def daily_counts(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows per calendar day in [start, end]."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    day = F.to_date(ts).alias("day")
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy("day")


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column], by=None) -> DataFrame:
    """Number of rows meeting each condition, in one pass."""
    aggs = [F.count_if(cond).alias(name) for name, cond in conditions.items()]
    keys = as_names(by)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def group_counts(df: DataFrame, by, latest: str | None = None) -> DataFrame:
    """Rows per group and, optionally, the largest value of a column."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if latest:
        aggs.append(F.max(latest).alias(f"max_{latest}"))
    return df.groupBy(*as_names(by)).agg(*aggs)
