"""Tables of Parquet files edited by key: only the files that hold a touched row are written anew.

A table is a folder. ``list-<version>.json`` names its live files and its schema; an edit
writes new files next to the old ones and then a list with the next version, so readers see
the table before or after an edit, and versions stay readable until ``prune`` drops files.
One writer at a time.

Rows are laid out by range of the key, so the keys of an edit lie in few files, and the range
of the edited keys reaches the scan: files outside it are skipped by their statistics.
Null keys match null keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from tablewright.core.layout import as_names
from tablewright.core.session import discard, stable
from tablewright.core.types import SchemaError, quoted, require_columns, spark_type
from tablewright.sources.sinks import delete_by_key, update_by_key

_FILE = "_tw_file"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass(frozen=True)
class FileTable:
    """One version of a table: its folder, number, schema and live files, named relative to the folder."""

    path: str
    version: int
    schema: StructType
    files: tuple[str, ...]

    def read(self, spark: SparkSession, files: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of this version, or of some of its files."""
        names = self.files if files is None else files
        if not names:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in names])

    def _next(self, files, schema: StructType | None = None) -> "FileTable":
        out = FileTable(self.path, self.version + 1, schema or self.schema, tuple(files))
        store, root = _store(self.path)
        entry = json.dumps({"schema": json.loads(out.schema.json()), "files": out.files})
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(entry.encode())
        store.move(draft, f"{root}/list-{out.version:09d}.json")
        return out

    def _write(self, df: DataFrame) -> list[str]:
        """Write rows into a new folder of the table; its files' names."""
        batch = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{batch}")
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{batch}"))
        return sorted(f"{batch}/{i.base_name}" for i in found if i.base_name.endswith(".parquet"))


def create_files(df: DataFrame, path: str, key, files: int | None = None) -> FileTable:
    """Write ``df`` as an editable table, laid out by range of ``key`` in about ``files`` files.

    A key value of many rows stays in one range; further columns in ``key`` split it.
    """
    keys = as_names(key)
    require_columns(df, keys)
    parts = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *[quoted(k) for k in keys]).sortWithinPartitions(*[quoted(k) for k in keys])
    store, root = _store(path)
    store.create_dir(root)
    if versions(path):
        raise ValueError(f"{path} holds a table")
    loose = StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])
    empty = FileTable(path, 0, loose, ())
    return empty._next(empty._write(rows))


def versions(path: str) -> list[int]:
    """The versions that have a list, oldest first."""
    store, root = _store(path)
    names = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    return sorted(int(n[5:-5]) for n in names if n.startswith("list-") and n.endswith(".json"))


def open_files(path: str, version: int | None = None) -> FileTable:
    """The newest version of a table, or a given one."""
    known = versions(path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {version if version is not None else ''}".rstrip())
    at = known[-1] if version is None else version
    store, root = _store(path)
    with store.open_input_stream(f"{root}/list-{at:09d}.json") as f:
        entry = json.loads(f.read().decode())
    return FileTable(path, at, StructType.fromJson(entry["schema"]), tuple(entry["files"]))


def _in_range(changes: DataFrame, keys: list[str]) -> Column:
    """Condition on the first key that every row with an edited key meets; it reaches the scan's statistics."""
    k = quoted(keys[0])
    low, high, gaps = changes.agg(F.min(k), F.max(k), F.count_if(k.isNull())).first()
    held = (k >= F.lit(low)) & (k <= F.lit(high)) if low is not None else F.lit(False)
    return held | k.isNull() if gaps else held


def _touched(table: FileTable, changes: DataFrame, keys: list[str]) -> tuple[str, ...]:
    """Files with a row whose key is in ``changes``: one name a file reaches the driver, which lists them anyway."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1).alias(_FILE)
    narrow = table.read(changes.sparkSession).where(_in_range(changes, keys)).select(*[quoted(k) for k in keys], name)
    wanted = changes.select(*[quoted(k).alias(f"_new_{k}") for k in keys])
    match = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"_new_{k}")) for k in keys])
    found = {r[0] for r in narrow.join(wanted, match, "left_semi").select(_FILE).distinct().collect()}
    return tuple(f for f in table.files if f in found)


def _edit(changes: DataFrame, path: str, key, work) -> FileTable:
    """Replace the touched files by ``work(their rows, changes, keys)`` and add the rows it gives besides."""
    keys, table = as_names(key), open_files(path)
    require_columns(changes, keys)
    unknown = [c for c in (*keys, *changes.columns) if c not in table.schema.names]
    if unknown:
        raise SchemaError(f"table has no columns {unknown}")
    fixed = stable(changes)  # read several times, always the same rows
    try:
        touched = _touched(table, fixed, keys)
        old = table.read(changes.sparkSession, touched)
        new = work(old, fixed, keys, bool(touched))
        kept = [f for f in table.files if f not in set(touched)]
        return table._next([*kept, *table._write(new)]) if new is not None else table
    finally:
        discard(fixed)


def update_files(changes: DataFrame, path: str, key) -> FileTable:
    """Replace the columns of ``changes`` where the key matches; at most one row a key. Other keys are left out."""
    return _edit(changes, path, key, lambda old, new, keys, any_: update_by_key(old, new, keys) if any_ else None)


def delete_files(keys_df: DataFrame, path: str, key) -> FileTable:
    """Remove the rows whose key is listed."""
    listed = keys_df.select(*[quoted(k) for k in as_names(key)])
    return _edit(listed, path, key, lambda old, new, keys, any_: delete_by_key(old, new, keys) if any_ else None)


def upsert_files(changes: DataFrame, path: str, key) -> FileTable:
    """Update matching keys and add the other rows; columns that ``changes`` lacks are null there."""

    def work(old: DataFrame, new: DataFrame, keys: list[str], any_: bool) -> DataFrame | None:
        # A key in an untouched file is in none of the changes, so the touched ones tell which keys are new.
        fresh = delete_by_key(new, old, keys) if any_ else new
        if not any_ and new.isEmpty():
            return None
        added = fresh.select(*[(quoted(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in old.schema.fields])
        return update_by_key(old, new, keys).unionByName(added)

    return _edit(changes, path, key, work)


def append_files(df: DataFrame, path: str) -> FileTable:
    """Add rows as further files; columns that ``df`` lacks are null."""
    table = open_files(path)
    unknown = [c for c in df.columns if c not in table.schema.names]
    if unknown:
        raise SchemaError(f"table has no columns {unknown}")
    rows = df.select(*[(quoted(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in table.schema.fields])
    return table._next([*table.files, *table._write(rows)])


def add_file_column(path: str, name: str, type: str) -> FileTable:
    """Add an empty column; no file is written."""
    table = open_files(path)
    if name in table.schema.names:
        raise SchemaError(f"column {name} exists")
    return table._next(table.files, StructType([*table.schema.fields, StructField(name, spark_type(type), True)]))


def prune(path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the files only those name; the number of files deleted."""
    if keep < 1:
        raise ValueError("keep starts at 1")
    known = versions(path)
    live = {f for v in known[-keep:] for f in open_files(path, v).files}
    dead = {f for v in known[:-keep] for f in open_files(path, v).files} - live
    store, root = _store(path)
    for v in known[:-keep]:
        store.delete_file(f"{root}/list-{v:09d}.json")
    for f in dead:
        store.delete_file(f"{root}/{f}")
    return len(dead)
