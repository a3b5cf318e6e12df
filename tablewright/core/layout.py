"""Ordered computations that stay distributed when one series is huge.

A window over one long series would run in a single task. Rows are therefore laid out by
range over (series, order, row hash), so that ties and hot series spread too, and written
once; each partition is solved by itself. Only the first series of a partition can have
begun earlier, so what earlier partitions add is at most one row per partition.
One way for every size: results and plans do not change as a table grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.core.session import stable

_POS_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33
LAG_BLOCK = 1_000_000  # rows of a series that one task looks at to find lags


def _names(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def as_names(value) -> list[str]:
    """A column name, a list of them or None, as a list."""
    return _names(value)


def _sort_columns(order_by) -> list[Column]:
    items = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in items]


def window(by, order_by) -> "Window":
    return Window.partitionBy(*_names(by)).orderBy(*_sort_columns(order_by))


def _row_hash(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0)


def _laid_out(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows in global (by, order) order with stable partition and position columns."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *order, _row_hash(df)]
    spread = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    marked = stable(spread.withColumn("_mid", F.monotonically_increasing_id()))
    return marked.select(
        "*",
        F.shiftright("_mid", _POS_BITS).alias("_part"),
        F.expr(f"_mid & ((1L << {_POS_BITS}) - 1)").alias("_pos"),
    ).drop("_mid")


def _with_offsets(rows: DataFrame, by: list[str], sums: Sequence[str]) -> DataFrame:
    """Join to each row the totals of its series in earlier partitions, and its place in this one."""
    per_part = rows.groupBy(*by, "_part").agg(
        F.min("_pos").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_tot_{i}") for i, c in enumerate(sums)],
    )
    # One row per (series, partition it touches): bounded by the partitions for any one series.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumns({
        "_skip": F.sum("_rows").over(before),
        **{f"_carry_{i}": F.sum(f"_tot_{i}").over(before) for i, _ in enumerate(sums)},
    })
    # Only a series that goes on from an earlier partition carries something: one a partition.
    carried = offsets.where("_skip > 0").select(
        F.col("_part").alias("_of_part"), *[F.col(c).alias(f"_by_{c}") for c in by], "_skip",
        *[f"_carry_{i}" for i, _ in enumerate(sums)])
    cond = F.col("_part") == F.col("_of_part")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(F.broadcast(carried), cond, "left").fillna(0, ["_skip"])


def row_index(df: DataFrame, order_by, by=None, name: str = "row_index") -> DataFrame:
    """Add the 1-based position of each row in its series.

    ``order_by`` should identify rows within a series; ties are in the order of a row hash.
    """
    by, order = _names(by), _sort_columns(order_by)
    rows = _with_offsets(_laid_out(df, by, order), by, [])
    here = F.row_number().over(Window.partitionBy("_part", *by).orderBy("_pos"))
    return rows.withColumn(name, (F.col("_skip") + here).cast("long")).select(*df.columns, name)


def running_sum(df: DataFrame, columns: dict[str, str], order_by, by=None) -> DataFrame:
    """Add running totals {new column: source column} in series order."""
    by, order = _names(by), _sort_columns(order_by)
    rows = _with_offsets(_laid_out(df, by, order), by, list(columns.values()))
    w = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({
        new: F.when(F.col(f"_carry_{i}").isNull(), F.sum(src).over(w)).otherwise(
            F.coalesce(F.sum(src).over(w), F.lit(0)) + F.col(f"_carry_{i}"))
        for i, (new, src) in enumerate(columns.items())
    })
    return out.select(*df.columns, *columns)


def lagged(df: DataFrame, columns: Sequence[str], lags: int, index: str, by=None,
           block: int = LAG_BLOCK) -> DataFrame:
    """Add ``{c}_lag{k}`` for k = 1..lags, using a gap-free row index.

    Rows are windowed in blocks of the index; the last ``lags`` rows of a block
    are also sent to the next one, so no task holds more than a block.
    """
    by = _names(by)
    own = F.floor((F.col(index) - 1) / F.lit(block))
    spill = ((F.col(index) - 1) % block) >= block - lags
    homes = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*by, "_block").orderBy(index)
    out = spread.withColumns(
        {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, lags + 1)}
    )
    return out.where("_own = _block").drop("_own", "_block")
