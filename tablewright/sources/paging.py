"""Deep pages: an ordered copy of a table with a directory of its parts.

``paged`` writes the rows once, in order, as parts of about equal size with the position of
each row in its part. The directory says how many rows lie before each part, so any page is a
filter on one part (or a few neighbours) and a range of positions, both of which reach the scan.
Rows that are equal in the order columns are in the order of a hash of the row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablewright.core.layout import _row_hash, _sort_columns
from tablewright.core.types import SchemaError

_POS_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33
_OWN = ("_part", "_pos")
_OWN_FIELDS = (StructField("_pos", LongType()), StructField("_part", IntegerType()))


@dataclass(frozen=True)
class Paged:
    """An ordered copy, its columns and its directory: (part, rows before it, its rows), one entry a part."""

    path: str
    schema: StructType
    parts: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return self.parts[-1][1] + self.parts[-1][2] if self.parts else 0

    def rows(self, spark: SparkSession, start: int, stop: int) -> DataFrame:
        """The rows from number ``start`` up to ``stop``, counted from 0, in order."""
        stored = spark.read.schema(StructType([*self.schema.fields, *_OWN_FIELDS])).parquet(f"{self.path}/rows")
        hits = [(p, max(start - skip, 0), min(stop - skip, n)) for p, skip, n in self.parts if start < skip + n and skip < stop]

        def within(part: int, low: int, high: int) -> Column:
            return (F.col("_part") == part) & (F.col("_pos") >= low) & (F.col("_pos") < high)

        # The parts alone, said once more, prune the folders that are read.
        here = F.col("_part").isin([p for p, _, _ in hits]) & reduce(lambda a, b: a | b, [within(*h) for h in hits], F.lit(False))
        return stored.where(here).orderBy(*_OWN).drop(*_OWN)

    def page(self, spark: SparkSession, page: int = 1, size: int = 10) -> DataFrame:
        """One page; past the last row it is empty."""
        if page < 1 or size < 1:
            raise ValueError("page and size start at 1")
        return self.rows(spark, (page - 1) * size, page * size)

    def page_with_total(self, spark: SparkSession, page: int = 1, size: int = 10, name: str = "total") -> DataFrame:
        """One page with the number of all rows, which the directory knows."""
        return self.page(spark, page, size).withColumn(name, F.lit(self.total).cast("long"))


def paged(df: DataFrame, order_by, path: str, parts: int | None = None) -> Paged:
    """Write ``df`` in the order of ``order_by`` (names or sort columns) and return its directory."""
    if taken := set(_OWN) & set(df.columns):
        raise SchemaError(f"the table has columns {sorted(taken)}")
    keys = [*_sort_columns(order_by), _row_hash(df)]
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(count, *keys).withColumn("_part", F.spark_partition_id())
    numbered = spread.sortWithinPartitions("_part", *keys).withColumn(
        "_pos", F.expr(f"monotonically_increasing_id() & ((1L << {_POS_BITS}) - 1)"))
    numbered.write.partitionBy("_part").parquet(f"{path}/rows")
    sizes = df.sparkSession.read.schema("_part int, _pos long").parquet(f"{path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    sizes.coalesce(1).write.parquet(f"{path}/directory")  # one row a part
    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{path}/columns")
    return open_paged(df.sparkSession, path)


def open_paged(spark: SparkSession, path: str) -> Paged:
    """The directory of a copy written before."""
    found, before = [], 0
    for part, n in sorted(tuple(r) for r in spark.read.schema("_part int, rows long").parquet(f"{path}/directory").collect()):
        found.append((part, before, n))
        before += n
    return Paged(path, spark.read.parquet(f"{path}/columns").schema, tuple(found))
