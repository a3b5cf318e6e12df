"""WARC archives with a two-level capture index.

Pages are written as gzip records, many archives at once; of equal payloads of at least
``least`` bytes one is a response and the others are revisit records that name it. The index
sorts captures by reversed-host URL key (then id, payload digest and kind) into compressed
blocks, and each index file ends with a sparse directory of its blocks (first line, place). A
lookup finds the file by its first line, the block by binary search in the directory, reads
only that block's range, and then only the record's range of the archive. Everything is read
back through the index: its blocks name the records, which are read in ranges of an archive,
and the response that a revisit names is looked up.

Defined results: ids are whole numbers; a null page counts as empty; a null url as an empty
one; null ids come last when the smallest id is chosen; rows that repeat the smallest id with
its payload are all responses; rows that repeat an id and url with other pages are captures of
their own; line breaks and blanks in a url are percent-encoded in headers and keys. Archives
of a task that was run again stay unread: only what the index names counts.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.llm.shared import filesystem, new_folder, sliced, stage

LEAST = 100
BLOCK_LINES = 256
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
CAPTURED = "2024-01-01T00:00:00Z"


def clean_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def url_key(url: str | None) -> str:
    """Host labels reversed, without scheme, ``www.``, default port and fragment, lower case: ``org,example)/path?query``."""
    text = clean_url(url)
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return text.lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/")
    return (key + ("?" + parts.query if parts.query else "")).lower()


def record_id(page_id, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers: tuple | None, captured: str = CAPTURED) -> bytes:
    """One record; ``refers`` is (page id, url) of the response that a revisit repeats."""
    uri = clean_url(url)
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, uri)), ("WARC-Date", captured),
            ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-Id", "" if page_id is None else page_id)]
    if refers:
        other = clean_url(refers[1])
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers[0], other)),
                 ("WARC-Refers-To-Target-URI", other), ("WARC-Refers-To-Date", captured), ("Refers-To-Page-Id", "" if refers[0] is None else refers[0])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (after the HTTP header) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.partition(": ")[::2] for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("the record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of ``data``, one after the other."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        one = zlib.decompressobj(31)
        yield one.decompress(view[at:]) + one.flush()
        at = len(view) - len(one.unused_data)


_CAPTURE = "key string, page_id bigint, digest string, kind string, file string, at bigint, bytes bigint"
_ORDER = ("key", "page_id", "digest", "kind")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page and return its capture: key, id, digest, kind, and where its record lies (a written table)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "url"))
    repeated = (rows.filter(F.length("payload") >= least).select("page_id", "url", "digest").groupBy("digest")
                .agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    known = rows.join(stage(repeated, "repeated"), "digest", "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches):
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        out, name, place = None, "", 0
        try:
            for batch in sliced(batches):
                made = []
                for page_id, url, body, digest, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or place >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    revisit = best is not None and best["page_id"] != page_id
                    refers = (best["page_id"], best["url"]) if revisit else None
                    data = gzip.compress(record(page_id, url, body, digest, refers), level, mtime=0)
                    out.write(data)
                    made.append((url_key(url), page_id, digest, "revisit" if revisit else "response", name, place, len(data)))
                    place += len(data)
                yield _batch(made, captures)
        finally:
            if out is not None:
                out.close()

    captures = T._parse_datatype_string(_CAPTURE)
    return stage(known.mapInArrow(run, captures), "captures")


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType.simpleString()]) for c, f in zip(cols, schema, strict=True)], names=schema.names)


def _order(key: str, page_id, digest: str, kind: str) -> tuple:
    return key, page_id is None, page_id or 0, digest, kind


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index; one row a file: its first line's ``key, page_id, digest, kind``, and ``file, directory_at, directory_bytes``.

    The rows are range-partitioned by the whole order, so that one very frequent key spreads too.
    """
    schema = T._parse_datatype_string("key string, page_id bigint, digest string, kind string, file string, directory_at bigint, directory_bytes bigint")

    def run(batches):
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        out, name, place, lines, directory = None, f"{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def flush():
            nonlocal place
            data = gzip.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode(), 6, mtime=0)
            directory.append((*lines[0][:4], place, len(data)))
            out.write(data)
            place += len(data)
            lines.clear()

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in (*_ORDER, "file", "at", "bytes")), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                lines.append(line)
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        data = gzip.compress(json.dumps(directory, separators=(",", ":")).encode(), 6, mtime=0)
        out.write(data)
        out.close()
        yield _batch([(*directory[0][:4], name, place, len(data))], schema)

    order = [F.col(c).asc_nulls_last() for c in _ORDER]
    return stage(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "index")


def read_index(index: DataFrame, folder: str) -> DataFrame:
    """The captures that the index names, block by block of each of its files."""
    schema = T._parse_datatype_string(_CAPTURE)
    files = index.select("file", "directory_at", "directory_bytes")
    files = files.repartition(min(max(1, files.count()), 20_000))  # the rows of a written table, one for each partition of the index

    def run(batches):
        store, path = filesystem(folder)
        for batch in batches:
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{file}") as f:
                    for *_, place, block in json.loads(gzip.decompress(f.read_at(size, at))):
                        yield _batch([tuple(json.loads(x)) for x in gzip.decompress(f.read_at(block, place)).decode().split("\n")], schema)

    return files.mapInArrow(run, schema)


class Reader:
    """Looks captures up; ``files`` are the rows of ``write_index`` in key order."""

    def __init__(self, index_folder: str, archive_folder: str, files: list[tuple]):
        self.store, self.index_path = filesystem(index_folder)
        self.archive_path = filesystem(archive_folder)[1]
        self.files = files
        self.firsts = [_order(*f[:4]) for f in files]
        self.open: dict[str, object] = {}
        self.directory: tuple[int, list] = (-1, [])
        self.block: tuple[tuple[int, int], list] = ((-1, -1), [])
        self.ranges = 0

    def range(self, path: str, at: int, size: int) -> bytes:
        if path not in self.open:
            if len(self.open) > 32:
                self.open.popitem()[1].close()
            self.open[path] = self.store.open_input_file(path)
        self.ranges += 1
        return self.open[path].read_at(size, at)

    def find(self, key: str, page_id, digest: str, kind: str = "response") -> list | None:
        """The index line of a capture: key, id, digest, kind, archive, place, bytes."""
        wanted = _order(key, page_id, digest, kind)
        f = bisect_right(self.firsts, wanted) - 1
        if f < 0:
            return None
        path = f"{self.index_path}/{self.files[f][4]}"
        if self.directory[0] != f:
            self.directory = f, json.loads(gzip.decompress(self.range(path, self.files[f][5], self.files[f][6])))
        blocks = self.directory[1]
        b = bisect_right(blocks, wanted, key=lambda x: _order(*x[:4])) - 1
        if self.block[0] != (f, b):
            text = gzip.decompress(self.range(path, blocks[b][4], blocks[b][5])).decode()
            self.block = (f, b), [json.loads(x) for x in text.split("\n")]
        lines = self.block[1]
        k = bisect_right(lines, wanted, key=lambda x: _order(*x[:4])) - 1
        return lines[k] if k >= 0 and _order(*lines[k][:4]) == wanted else None

    def read(self, line: list) -> tuple[dict[str, str], bytes]:
        return parse(gzip.decompress(self.range(f"{self.archive_path}/{line[4]}", line[5], line[6])))


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, refers_key string, refers_digest string"


def _id(text: str | None):
    return int(text) if text else None


def scan_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Every record of ``captures`` read back from the archives, in ranges of about 16 MB of one archive a row."""
    ranges = captures.groupBy("file", F.floor(F.col("at") / RANGE_BYTES).alias("part")).agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("bytes")).alias("end"))
    schema = T._parse_datatype_string(_READ)
    ranges = stage(ranges, "ranges")  # a few numbers for each 16 MB; dealt one by one, whatever their own size
    ranges = ranges.repartition(min(max(1, ranges.count()), 20_000))

    def run(batches):
        store, path = filesystem(folder)
        for batch in batches:
            for file, _, at, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{file}") as f:
                    data = f.read_at(end - at, at)
                rows = []
                for raw in members(data):
                    fields, payload = parse(raw)
                    revisit = fields["WARC-Type"] == "revisit"
                    own = (None, None) if revisit else (len(payload), hashlib.sha256(payload).hexdigest())
                    rows.append((_id(fields["Page-Id"]), *own, fields["WARC-Type"], _id(fields.get("Refers-To-Page-Id")) if revisit else None,
                                 url_key(fields["WARC-Refers-To-Target-URI"]) if revisit else None,
                                 fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else None))
                yield _batch(rows, schema)

    return ranges.mapInArrow(run, schema)


_TARGET = ("refers_key", "refers_to", "refers_digest")


def resolve(targets: DataFrame, index: DataFrame, index_folder: str, archive_folder: str) -> DataFrame:
    """``refers_key, refers_to, refers_digest, target_bytes, target_digest`` of the wanted responses, each by the index and two range reads."""
    files = sorted((tuple(r) for r in index.collect()), key=lambda f: _order(*f[:4]))  # one row an index file
    schema = T._parse_datatype_string("refers_key string, refers_to bigint, refers_digest string, target_bytes bigint, target_digest string")

    def run(batches):
        reader = Reader(index_folder, archive_folder, files)
        for batch in batches:
            rows = []
            for key, page_id, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = reader.find(key, page_id, digest)
                if line is None:
                    raise LookupError(f"no capture of {key} with id {page_id}")
                _, payload = reader.read(line)
                rows.append((key, page_id, digest, len(payload), hashlib.sha256(payload).hexdigest()))
            yield _batch(rows, schema)

    return targets.repartitionByRange(*_TARGET).sortWithinPartitions(*_TARGET).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write archives and index, read everything back: one row a record with size and digest of its full payload."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    archives, blocks = f"{folder}/archive", f"{folder}/index"
    index = write_index(write_archives(pages, archives, least), blocks)
    records = stage(scan_archives(read_index(index, blocks), archives), "records")
    wanted = records.filter("record_type = 'revisit'").select(*_TARGET).distinct()
    targets = resolve(wanted, index, blocks, archives)
    same = [records[c].eqNullSafe(targets[c]) for c in _TARGET]
    joined = records.join(targets, same[0] & same[1] & same[2], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"),
                         F.coalesce("payload_digest", "target_digest").alias("payload_digest"), "record_type", records["refers_to"])
