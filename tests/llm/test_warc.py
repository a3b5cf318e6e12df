from __future__ import annotations

import gzip
import hashlib

import pytest

from tablewright.llm import warc as W

BIG = "<html>" + "x" * 200
ROWS = [(5, "https://www.b.example.org/p?q=1", BIG), (3, "http://a.example.org/", BIG), (9, None, BIG), (None, "http://n.example.org/", BIG),
        (1, "http://c.example.org/", "small"), (2, "http://c.example.org/", "small"), (4, "not a url \n x", None), (6, "http://d.example.org:8080/ä b", ""),
        (7, "HTTP://[bad", "é" * 60), (8, "https://d.example.org", "é" * 60), (10, "http://c.example.org/", "y" * 100), (11, "http://c.example.org/", "y" * 100),
        (12, "http://c.example.org/", "z" * 99), (13, "http://c.example.org/", "z" * 99), (14, "http://w.example.org/", "long " * 400_000)]


def expected(rows):
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        same = [j for j, _, u in rows if (u or "").encode() == raw and j is not None]
        first = min(same, default=None)
        revisit = len(raw) >= 100 and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def key(r):
    return r[0] is None, r[0] or 0, r[2]


@pytest.mark.parametrize("rows", [ROWS, ROWS + [(100 + i, f"http://h{i % 5}.example.com/{i}", BIG) for i in range(700)]])
def test_round_trip(spark, rows):
    got = [tuple(r) for r in W.round_trip(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_repeated_rows_and_empty(spark):
    twice = [(3, "http://a.example.org/", BIG)] * 2 + [(5, "http://a.example.org/", BIG)]
    got = sorted((r.page_id, r.record_type) for r in W.round_trip(frame(spark, twice)).collect())
    assert got == [(3, "response"), (3, "response"), (5, "revisit")]
    assert W.round_trip(frame(spark, ROWS).limit(0)).count() == 0


def test_index_reads_little(spark, tmp_path):
    rows = [(i, f"http://www.h{i % 9}.example.com/page/{i}", f"page {i} " * 30) for i in range(2_000)]
    folder = f"file://{tmp_path}"
    captures = W.write_archives(frame(spark, rows), folder + "/a")
    index = W.write_index(captures, folder + "/i", block_lines=16)
    files = sorted((tuple(r) for r in index.collect()), key=lambda f: W._order(*f[:4]))
    reader = W.Reader(folder + "/i", folder + "/a", files)
    digest = [hashlib.sha256(t.encode()).hexdigest() for _, _, t in rows]
    for i in (0, 7, 1_234, 1_999):
        before = reader.ranges
        line = reader.find(W.url_key(rows[i][1]), i, digest[i])
        fields, payload = reader.read(line)
        assert payload.decode() == rows[i][2] and fields["WARC-Type"] == "response" and fields["WARC-Target-URI"] == rows[i][1]
        assert reader.ranges - before <= 3
    assert reader.find("com,example,none)/", 1, digest[1]) is None and reader.find(W.url_key(rows[5][1]), 6, digest[6]) is None and reader.find("", 0, "") is None
    assert reader.find(W.url_key(rows[5][1]), 5, digest[6]) is None and reader.find(W.url_key(rows[5][1]), 5, digest[5], "revisit") is None
    assert sorted(map(tuple, W.read_index(index, folder + "/i").collect())) == sorted(map(tuple, captures.collect()))
    assert sum(1 for _ in (tmp_path / "i").glob("*.cdx.gz")) == len(files)


def test_pages_that_repeat_an_id_and_url(spark):
    """Each capture has its own payload, and a revisit gets the one it repeats."""
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, "u", a), (1, "u", b), (2, "v", a), (3, "w", b), (1, "u", c), (1, "u", c), (0, "t", c), (None, "u", a), (None, "u", "x"), (None, "u", "y")]
    got = sorted(map(tuple, W.round_trip(frame(spark, rows)).collect()), key=key)
    assert got == sorted(expected(rows), key=key)
    many = [(1, "u", f"{i % 700} " * 40) for i in range(1_400)] + [(2, "v", f"{i} " * 40) for i in range(700)]
    got = sorted(map(tuple, W.round_trip(frame(spark, many)).collect()), key=key)
    assert got == sorted(expected(many), key=key)


def test_keys_and_records():
    assert W.url_key("https://www.B.example.org:443/P?q=1#top") == "org,example,b)/p?q=1"
    assert W.url_key("http://b.example.org:81") == "org,example,b:81)/"
    raw = W.record(3, "http://a.example/x y\r\nEvil: 1", b"body\r\n\r\nmore", "00", None)
    fields, payload = W.parse(raw)
    assert payload == b"body\r\n\r\nmore" and "Evil" not in fields and fields["WARC-Target-URI"] == "http://a.example/x%20y%0D%0AEvil:%201"
    assert list(W.members(gzip.compress(raw) + gzip.compress(b"two"))) == [raw, b"two"]
    with pytest.raises(ValueError):
        W.parse(raw[:-10])
