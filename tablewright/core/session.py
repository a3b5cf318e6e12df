"""Session helpers: reliable checkpoints and bounded-size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows one task may hold when a group has to be processed as a whole.
GROUP_LIMIT = 1_000_000

_MADE: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    The cluster's ``spark.checkpoint.dir`` wins. A machine-local folder is only
    made up for a local master, where driver and executors share one disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tablewright-ckpt-")
    sc.setCheckpointDir(path)
    return path


def stable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table on shared storage and continue from that table.

    Every later reader sees the same rows, also after executors are lost, reads
    only the columns it needs, and the optimizer knows the true size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stable`` returned, once nothing reads it any more."""
    path = getattr(df, "stable_path", None)
    if path in _MADE:
        _MADE.remove(path)
        _delete(path)


def _delete(path: str) -> None:
    store, plain = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if store.get_file_info(plain).type == fs.FileType.Directory:
        store.delete_dir(plain)


def release() -> None:
    """Delete the tables written by ``stable``; done when the process ends."""
    while _MADE:
        _delete(_MADE.pop())


atexit.register(release)


def hold(df: DataFrame) -> DataFrame:
    """Keep the input of an iterative fit; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Row count of the largest group (of the whole table without keys)."""
    if not by:
        return df.count()
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0
