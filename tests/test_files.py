from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.core.types import SchemaError
from tablewright.sources import files


def rows(table, spark):
    return sorted(tuple(r) for r in table.read(spark).collect())


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(10_000).selectExpr("id k", "id * 2 v", "string(id) s")
    return files.create_files(df, str(tmp_path / "t"), "k", files=16)


def test_an_update_writes_only_the_touched_files(spark, table):
    before = rows(table, spark)
    new = files.update_files(spark.createDataFrame([(5, -1), (7, -2), (20_000, -3)], "k long, v long"), table.path, "k")
    assert len(table.files) == 16 and len(set(table.files) - set(new.files)) == 1
    assert rows(new, spark) == sorted((k, {5: -1, 7: -2}.get(k, v), s) for k, v, s in before)
    assert rows(files.open_files(table.path, 1), spark) == before
    again = files.update_files(spark.createDataFrame([(20_000, -3)], "k long, v long"), table.path, "k")
    assert again == new


def test_deletes_and_upserts(spark, table):
    before = rows(table, spark)
    gone = spark.createDataFrame([(0,), (1,), (1,), (9_999,), (77_777,)], "k long")
    less = files.delete_files(gone, table.path, "k")
    assert rows(less, spark) == [r for r in before if r[0] not in (0, 1, 9_999)]
    assert len(set(table.files) & set(less.files)) == 14
    more = files.upsert_files(spark.createDataFrame([(3, 1), (12_345, 2)], "k long, v long"), table.path, "k")
    want = {r[0]: r for r in rows(less, spark)} | {3: (3, 1, "3"), 12_345: (12_345, 2, None)}
    assert sorted(tuple(r) for r in more.read(spark).collect()) == sorted(want.values(), key=lambda r: r[0])
    assert len(set(less.files) & set(more.files)) == len(less.files) - 1
    only_new = files.upsert_files(spark.createDataFrame([(50_000, 2)], "k long, v long"), table.path, "k")
    assert set(more.files) < set(only_new.files)


def test_null_keys_repeated_keys_and_several_key_columns(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (1, "a", 3), (1, "a", 4), (2, None, 5)], "k int, g string, v int")
    path = str(tmp_path / "t")
    files.create_files(df, path, ["k", "g"], files=4)
    got = files.update_files(spark.createDataFrame([(None, "a", 10), (1, "a", 30), (2, None, 50)], "k int, g string, v int"), path, ["k", "g"])
    assert sorted((r.v for r in got.read(spark).collect())) == [2, 10, 30, 30, 50]
    got = files.delete_files(spark.createDataFrame([(None, "b"), (2, None)], "k int, g string"), path, ["k", "g"])
    assert sorted((r.v for r in got.read(spark).collect())) == [10, 30, 30]


def test_columns_versions_and_empty_tables(spark, table, tmp_path):
    wider = files.add_file_column(table.path, "w", "NUMBER")
    assert wider.files == table.files and wider.read(spark).agg(F.count("w"), F.count("k")).first()[:] == (0, 10_000)
    with pytest.raises(SchemaError):
        files.add_file_column(table.path, "w", "NUMBER")
    with pytest.raises(SchemaError):
        files.update_files(spark.createDataFrame([(1, 1)], "k long, z long"), table.path, "k")
    with pytest.raises(ValueError):
        files.open_files(table.path, 9)
    with pytest.raises(ValueError):
        files.create_files(spark.range(1), table.path, "id")
    filled = files.update_files(spark.createDataFrame([(4, 2.5)], "k long, w double"), table.path, "k")
    assert filled.read(spark).where("w is not null").select("k", "w").first()[:] == (4, 2.5)
    assert files.versions(table.path) == [1, 2, 3]
    assert files.prune(table.path) == 1 and files.versions(table.path) == [3]
    assert files.open_files(table.path).read(spark).count() == 10_000
    path = str(tmp_path / "empty")
    files.create_files(spark.createDataFrame([], "k long, v long"), path, "k")
    none = spark.createDataFrame([], "k long, v long")
    for edit in (files.update_files, files.delete_files, files.upsert_files):
        assert edit(none, path, "k").read(spark).count() == 0
    assert rows(files.upsert_files(spark.createDataFrame([(1, 2)], "k long, v long"), path, "k"), spark) == [(1, 2)]
    assert files.append_files(spark.createDataFrame([(5,)], "v long"), path).read(spark).where("k is null").first().v == 5


def test_the_key_range_reaches_the_scan(spark, table):
    wanted = spark.createDataFrame([(5,), (9,)], "k long")
    text = table.read(spark).where(files._in_range(wanted, ["k"]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k,5)" in text and "LessThanOrEqual(k,9)" in text
    assert Path(table.path, table.files[0]).exists()
