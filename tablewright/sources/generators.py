"""Generated tables: ranges, single values, simulations and formula tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.core.types import spark_type
from tablewright.functions.expressions import compile_expression


def int_range(spark: SparkSession, start: int, stop: int, step: int = 1,
              key: str = "value") -> DataFrame:
    """Integers from start to stop inclusive; empty if start > stop or step is 0."""
    whole = all(isinstance(v, int) and not isinstance(v, bool) for v in (start, stop, step))
    if not whole or step <= 0 or start > stop:
        return spark.createDataFrame([], f"`{key}` long")
    return spark.range(start, stop + 1, step).withColumnRenamed("id", key)


def year_range(spark: SparkSession, start: int, stop: int) -> DataFrame:
    return int_range(spark, int(start), int(stop), 1, "year")


def _date_range(spark: SparkSession, start: str, stop: str, fmt: str, pattern: str,
                unit: str, name: str) -> DataFrame:
    try:
        lo = datetime.strptime(str(start), fmt).date()
        hi = datetime.strptime(str(stop), fmt).date()
    except ValueError as exc:
        raise ValueError(f"bad {name} range {start!r}..{stop!r}") from exc
    if unit == "MONTH":
        steps = (hi.year - lo.year) * 12 + hi.month - lo.month
        at = F.add_months(F.lit(lo), F.col("id").cast("int"))
    else:
        steps = (hi - lo).days
        at = F.date_add(F.lit(lo), F.col("id").cast("int"))
    return spark.range(0, steps + 1).select(F.date_format(at, pattern).alias(name))


def month_range(spark: SparkSession, start: str, stop: str) -> DataFrame:
    """Months ``yyyy-MM`` from start to stop inclusive, as strings."""
    return _date_range(spark, start, stop, "%Y-%m", "yyyy-MM", "MONTH", "month")


def day_range(spark: SparkSession, start: str, stop: str) -> DataFrame:
    """Days ``yyyy-MM-dd`` from start to stop inclusive, as strings."""
    return _date_range(spark, start, stop, "%Y-%m-%d", "yyyy-MM-dd", "DAY", "day")


def single_value(spark: SparkSession, value, type: str = "NUMBER") -> DataFrame:
    """One row, one column ``value``."""
    if isinstance(value, (date, datetime)):
        value = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return spark.range(1).select(F.lit(value).cast(spark_type(type)).alias("value"))


def uniform_draw(row_id: Column, seed: int, name: str) -> Column:
    """Reproducible draw in [0, 1): 48 bits of an md5 of row, seed and column name."""
    digest = F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(str(seed)), F.lit(name)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def monte_carlo(spark: SparkSession, n: int, bounds: Mapping[str, tuple[float, float]],
                seed: int = 0) -> DataFrame:
    """``n`` rows with one independent U(lo, hi) column per entry of ``bounds``.

    Draws depend only on (row, seed, column), so a lost task redraws the same values.
    """
    draws = []
    for name, (lo, hi) in bounds.items():
        u = uniform_draw(F.col("id"), seed, name)
        draws.append((F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * u).alias(name))
    return spark.range(n).select(*draws)


def formula_table(spark: SparkSession, n: int, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """``n`` rows computed from formulas over the row number ``i`` (1-based)."""
    df = spark.range(1, n + 1).withColumnRenamed("id", "i")
    for name, formula in columns:
        df = df.withColumn(name, compile_expression(formula, df.columns).cast("double"))
    return df
