"""Stable tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one is made up only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tablewright-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage: what a lost executor computed is read again, not computed again,
    and every reader sees the same rows.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a Spark path, also inside tasks."""
    path = path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def release() -> None:
    """Delete the staged tables. Call it when no result that reads them is needed any more."""
    while _MADE:
        store, path = filesystem(_MADE.pop())
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


atexit.register(release)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task makes of whole texts stays small too."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, whatever its estimated size.

    Spark takes the size of written tables from their compressed files and does not see that
    an explode or an Arrow function makes many rows of one, so it may broadcast a table that
    the driver cannot hold.
    """
    return df.hint("merge")


def wrapped(df: DataFrame, **extra) -> DataFrame:
    """All columns as one struct ``row`` beside helper columns, so that no name can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[e.alias(k) for k, e in extra.items()])
