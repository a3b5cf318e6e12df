"""Writing tables: snapshots, mapped appends and keyed copy-on-write edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.core.layout import as_names
from tablewright.core.types import SchemaError, quoted, require_columns, spark_type

LOAD_TS = "load_ts"


def snapshot(df: DataFrame, target: str, ts_col: str = LOAD_TS, mode: str = "errorifexists",
             path: str | None = None) -> None:
    """Copy a table in one consistent scan, stamping the load time."""
    writer = df.withColumn(ts_col, F.current_timestamp()).write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(target)


def create_table(spark: SparkSession, rows, fields: Sequence[tuple[str, str]], target: str,
                 ts_col: str = LOAD_TS, path: str | None = None) -> DataFrame:
    """Create a managed table from supplied rows or from a DataFrame."""
    if isinstance(rows, DataFrame):
        require_columns(rows, [n for n, _ in fields])
        df = rows.select(*[quoted(n).cast(spark_type(t)).alias(n) for n, t in fields])
    else:
        schema = ", ".join(f"`{n}` {spark_type(t).simpleString()}" for n, t in fields)
        df = spark.createDataFrame(rows, schema)
    snapshot(df, target, ts_col, path=path)
    return spark.table(target)


def map_columns(df: DataFrame, mapping: Sequence[tuple[str, str]],
                target_columns: Sequence[str]) -> DataFrame:
    """Rename source columns to target columns; unmapped source columns are dropped."""
    require_columns(df, [s for s, _ in mapping])
    unknown = [t for _, t in mapping if t not in target_columns]
    if unknown:
        raise SchemaError(f"target has no columns {unknown}")
    return df.select(*[quoted(s).alias(t) for s, t in mapping])


def append_mapped(df: DataFrame, target: str, mapping: Sequence[tuple[str, str]],
                  jdbc: dict | None = None) -> None:
    """Append to an existing table through a column map; other target columns are null."""
    spark = df.sparkSession
    if jdbc:
        known = spark.read.format("jdbc").options(**jdbc).option("dbtable", target).load()
        out = map_columns(df, mapping, known.columns)
        out.write.format("jdbc").options(**jdbc).option("dbtable", target).mode("append").save()
        return
    known = spark.table(target)
    mapped = map_columns(df, mapping, known.columns)
    filled = [
        (quoted(f.name) if f.name in mapped.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in known.schema.fields
    ]
    mapped.select(*filled).write.mode("append").insertInto(target)


def append(df: DataFrame, target: str, ts_col: str = LOAD_TS) -> None:
    """Append rows to a managed table, stamping the load time."""
    stamped = df.withColumn(ts_col, F.current_timestamp())
    append_mapped(stamped, target, [(c, c) for c in stamped.columns])


def publish(results: dict[str, DataFrame], prefix: str = "") -> dict[str, DataFrame]:
    """Expose named results as temporary views."""
    for name, df in results.items():
        df.createOrReplaceTempView(prefix + name)
    return results


def checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Write a node's output and continue from the written copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matched(df: DataFrame, changes: DataFrame, keys: list[str], how: str) -> DataFrame:
    require_columns(df, keys)
    require_columns(changes, keys)
    unknown = [c for c in changes.columns if c not in df.columns]
    if unknown:
        raise SchemaError(f"table has no columns {unknown}")
    marked = changes.select(*[quoted(c).alias(f"_new_{c}") for c in changes.columns],
                            F.lit(True).alias("_hit"))
    cond = [quoted(k).eqNullSafe(quoted(f"_new_{k}")) for k in keys]
    joined = df.withColumn("_old", F.lit(True)).join(marked, cond, how)
    out = []
    for f in df.schema.fields:
        if f.name not in changes.columns:
            out.append(quoted(f.name))
            continue
        new = quoted(f"_new_{f.name}").cast(f.dataType)
        out.append(F.when(F.col("_hit"), new).otherwise(quoted(f.name)).alias(f.name))
    return joined.select(*out)


def update_by_key(df: DataFrame, changes: DataFrame, key) -> DataFrame:
    """Rows of ``df`` with the columns of ``changes`` replaced where the key matches.

    ``changes`` holds at most one row per key.
    """
    return _matched(df, changes, as_names(key), "left")


def upsert(df: DataFrame, changes: DataFrame, key) -> DataFrame:
    """Update matching keys and insert the others."""
    keys = as_names(key)
    updated = _matched(df, changes, keys, "left")
    fresh = delete_by_key(changes, df, keys)
    return updated.unionByName(fresh, allowMissingColumns=True)


def delete_by_key(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Rows of ``df`` whose key is not listed in ``keys``."""
    names = as_names(key)
    listed = keys.select(*[quoted(k).alias(f"_del_{k}") for k in names]).distinct()
    cond = [quoted(k).eqNullSafe(quoted(f"_del_{k}")) for k in names]
    return df.join(listed, cond, "left_anti")


def add_column(df: DataFrame, name: str, type: str) -> DataFrame:
    """Add an empty column."""
    if name in df.columns:
        raise SchemaError(f"column {name} exists")
    return df.withColumn(name, F.lit(None).cast(spark_type(type)))
