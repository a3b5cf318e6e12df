"""Reading, binding, describing and previewing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.core.layout import as_names
from tablewright.core.types import DATE, SchemaError, quoted, require_columns, spark_type, to_logical
from tablewright.functions.convert import to_date_column


def read_table(spark: SparkSession, fmt: str, source: str, columns: Sequence[str] | None = None,
               schema=None, **options) -> DataFrame:
    """Read a table.

    ``fmt`` is ``table`` for a catalog table, ``jdbc`` (``source`` is the remote
    table; pass ``url`` and, to read in parallel, ``partitionColumn``,
    ``lowerBound``, ``upperBound``, ``numPartitions``) or any file format.
    """
    if fmt == "table":
        df = spark.table(source)
    elif fmt == "csv":
        df = read_csv(spark, source, schema, **options)
    else:
        reader = spark.read.format(fmt).options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.option("dbtable", source).load() if fmt == "jdbc" else reader.load(source)
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*[quoted(c) for c in columns])
    return df


def read_csv(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """CSV with a header and a declared schema; empty, NaN and NaT cells are null.

    Cells that do not parse fail the read instead of turning into nulls.
    """
    if schema is None:
        raise SchemaError("CSV needs a schema")
    settings = {"header": True, "mode": "FAILFAST", "nullValue": "", "positiveInf": "inf",
                "negativeInf": "-inf", **options}
    df = spark.read.options(**settings).schema(schema).csv(path)
    fixes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = F.nanvl(quoted(f.name), F.lit(None))
        elif isinstance(f.dataType, T.StringType):
            fixes[f.name] = F.when(~quoted(f.name).isin("NaN", "NaT", "nan"), quoted(f.name))
    return df.withColumns(fixes) if fixes else df


def bind_table(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Check the declared columns exist, put them in order and parse the dates."""
    require_columns(df, [name for name, _ in columns])
    out = []
    for name, logical in columns:
        col = quoted(name)
        if logical == DATE and to_logical(df.schema[name].dataType) != DATE:
            col = to_date_column(col, strict=True)
        elif logical != DATE:
            col = col.cast(spark_type(logical))
        out.append(col.alias(name))
    return df.select(*out)


def describe_tables(spark: SparkSession, name_filter: str = "", database: str | None = None,
                    page: int = 1, size: int = 10) -> DataFrame:
    """Page of catalog tables whose name contains ``name_filter``."""
    listing = spark.sql("SHOW TABLES" + (f" IN `{database}`" if database else ""))
    found = listing.select(F.col("tableName").alias("name"), "isTemporary")
    found = found.where(F.col("name").contains(name_filter))
    return found.orderBy("name").offset((page - 1) * size).limit(size)


def describe_columns(df: DataFrame) -> DataFrame:
    """Column name, position, logical type, storage type and nullability."""
    rows = [
        (i, f.name, f.metadata.get("nick_name", f.name), to_logical(f.dataType),
         f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, nick_name string, data_type string, "
              "storage_type string, nullable boolean")


def column_counts(df: DataFrame) -> DataFrame:
    """(name, present, different): cells that are not null, and distinct values, per column; one pass of the long form."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("cell")) for c in df.columns])).alias("c"))
    per_value = cells.select("c.*").groupBy("name", "cell").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("cell").isNotNull()
    return per_value.groupBy("name").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("present"), F.count_if(there).alias("different"))


def describe_source(spark: SparkSession, fmt: str, source: str, **options) -> DataFrame:
    """Columns of a source; only its schema is read."""
    return describe_columns(read_table(spark, fmt, source, **options))


def search(df: DataFrame, key: str | None) -> DataFrame:
    """Rows in which any column, as text, contains ``key``."""
    if not key:
        return df
    return df.where(reduce(or_, [F.coalesce(quoted(c).cast("string").contains(key), F.lit(False))
                                 for c in df.columns]))


def page(df: DataFrame, order_by, page: int = 1, size: int = 10) -> DataFrame:
    """One page of an ordered table."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    keys = [F.col(c) if isinstance(c, str) else c for c in
            (order_by if isinstance(order_by, (list, tuple)) else as_names(order_by))]
    return df.orderBy(*keys).offset((page - 1) * size).limit(size)


def page_with_total(df: DataFrame, order_by, page_no: int = 1, size: int = 10, name: str = "total") -> DataFrame:
    """One page of an ordered table with the number of all rows beside each row."""
    total = df.agg(F.count(F.lit(1)).alias(name))  # one row
    return page(df, order_by, page_no, size).crossJoin(F.broadcast(total))


def preview(df: DataFrame, order_by, search_key: str | None = None, page_no: int = 1,
            size: int = 10) -> DataFrame:
    """Ordered page of the rows matching ``search_key``."""
    return page(search(df, search_key), order_by, page_no, size)
