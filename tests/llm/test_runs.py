from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, runs as R
from tests.conftest import SMALL

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def plain(w):
    """Runs by trying every period."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("n", [16, 64, 128, 2048, 16384])
def test_transform_is_exact(n):
    x = np.random.default_rng(n).integers(0, 900, (2, n, 3)).astype(float)
    y = np.random.default_rng(n + 1).integers(0, 900, (2, n, 3)).astype(float)
    assert np.array_equal(R.inverse(R.forward(x)) % R.PRIME, x)
    got = R.inverse(R._reduced(R.forward(x) * R.forward(y))) % R.PRIME
    a, b = x[0, :, 0].astype(int), y[0, :, 0].astype(int)
    for t in (0, 1, n - 1):
        assert int(got[0, t, 0]) == sum(int(a[i]) * int(b[(t - i) % n]) for i in range(n)) % R.PRIME


def texts(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.choice([0, 1, 23, 24, 25, 60, 300, 700]))]
        for _ in range(rng.randrange(4)):
            if len(w) > 40:
                a, q = rng.randrange(len(w)), rng.randrange(1, len(w) // 4)
                for i in range(a + q, min(len(w), a + rng.randrange(len(w)))):
                    w[i] = w[i - q]
        yield w


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_every_period(seed):
    ws = list(texts(seed))
    counts, found, out = R._worked([" ".join(w).encode() for w in ws])
    assert counts == [len(w) for w in ws]
    assert found == [plain(w) for w in ws]
    assert [o.decode() for o in out] == [collapsed(w, f) for w, f in zip(ws, found, strict=True)]


def test_fingerprints_that_lie_are_caught(monkeypatch):
    """With fingerprints that call everything equal, the word-by-word way still gives the right runs."""
    real = R._Prints.equal
    monkeypatch.setattr(R._Prints, "equal", lambda self, at, gap, n: real(self, at, gap, n) | (n == 1))
    ws = [w for w in texts(9) if len(w) < 100]
    _, found, _ = R._worked([" ".join(w).encode() for w in ws])
    assert found == [plain(w) for w in ws]


def test_long_texts():
    unit = [f"w{i}" for i in range(40_000)]
    far = unit * 3 + ["x"] + ["a"] * 100_000 + ["y"] + ["a", "b"] * 50_000
    _, (found,), _ = R._worked([" ".join(far).encode()])
    assert found == [(0, 120_000, 40_000), (120_001, 100_000, 1), (220_002, 100_000, 2)]


def test_blocks_no_larger_than_the_bound(monkeypatch):
    """Windows longer than the largest block are looked up in parts."""
    monkeypatch.setattr(R, "LARGEST", 16)
    ws = list(texts(5))
    assert R._worked([" ".join(w).encode() for w in ws])[1] == [plain(w) for w in ws]


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (4, "a " * 30, 7), (4, "a " * 30, 7), (None, "b " * 24, 7), (5, " x " * 23, 7), (6, "z" * 300_000, 7),
            (7, "one two\x0bthree\x0c" * 10, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in R.find(df).collect()}
    assert got == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 30, ((0, 30, 1),), "a"), (None, 24, ((0, 24, 1),), "b"), (5, 23, (), " ".join([" x"] * 23)),
                   (6, 1, (), "z" * 300_000), (7, 30, ((0, 30, 3),), "one two three")}
    assert R.find(df).count() == len(rows) and R.find(df.limit(0)).collect() == []


def test_longest(spark):
    df = spark.sql("""select array(named_struct('start', 9L, 'length', 30L, 'period', 10L), named_struct('start', 50L, 'length', 24L, 'period', 8L),
      named_struct('start', 5L, 'length', 24L, 'period', 8L)) as a, cast(array() as array<struct<start:bigint,length:bigint,period:bigint>>) as b""")
    a, b = df.select(R.longest(F.col("a")), R.longest(F.col("b"))).first()
    assert tuple(a) == (5, 24, 8) and b is None


def test_query(spark):
    """The registered query against a plain version on the whole table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in docs:
        w = words_of(r["text"])
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain(w)
        best = (None,) * 4
        if found:
            s, length, q = min(found, key=lambda f: (-f[1] / f[2], f[0], f[2]))
            best = s, length, q, 1000 * length // q
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want.add((r["doc_id"], len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest()))
    got = {tuple(r) for r in queries.op11_repeated_runs(spark, SMALL).collect()}
    assert got == want and len(want) == len(docs) and sum(x[1] > 0 for x in want) > 5
