from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.core import session


def test_stable_copies_live_in_the_named_folder(spark):
    folder = session.ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (configured or spark.sparkContext.getCheckpointDir())
    df = spark.range(10).withColumn("r", F.rand())
    kept = session.stable(df)
    assert folder.removeprefix("file:").rstrip("/") in kept.inputFiles()[0]
    assert kept.exceptAll(kept).count() == 0 and kept.columns == ["id", "r"]


def test_copies_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    kept = session.stable(spark.range(3))
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    session.release()
    assert not Path(folder).exists() and session._MADE == []


@pytest.mark.parametrize("by,want", [([], 6), (["k"], 4)])
def test_largest_group(spark, by, want):
    df = spark.createDataFrame([(1,), (1,), (1,), (1,), (2,), (None,)], "k int")
    assert session.largest_group(df, by) == want
