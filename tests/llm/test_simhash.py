from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import components as C, simhash as S


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "")) if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def roots(values, bits=2):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É ß Ä x y z", "a b c d a b c d", "w " * 70_000 + "end of it"])
def test_fingerprint(text):
    raw = None if text is None else text.encode()
    assert S.fingerprint(raw) == plain(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def clustered(seed, centers, members, flips):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(centers):
        c = rng.getrandbits(64)
        for _ in range(members):
            v = c
            for _ in range(rng.randrange(flips + 1)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize(("segments", "crowd"), [(16, 8), (16, 1), (32, 4), (8, 2)])
def test_links_lose_nothing(spark, segments, crowd):
    values = clustered(5, 12, 25, 4)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = S.links(df, 2, segments, crowd)
    got = {r.node: r.root for r in C.components(edges).collect()}
    want = roots(values)
    groups_want = {}
    for v, s in zip(values, signed, strict=True):
        groups_want.setdefault(want[v], set()).add(s)
    groups_got = {}
    for s in signed:
        groups_got.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups_want.values())) == sorted(map(sorted, groups_got.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1_000, 2_000 + i) for i in range(50)] + [(5_000, 5_000), (7_001, 7_000)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[2_000 + i] == 1_000 for i in range(50))
    assert got[7_001] == got[7_000] == 7_000 and 5_000 not in got
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (4, base.upper()), (7, base + " x"), (3, None), (8, ""), (5, "other text here now"), (None, base), (11, "solo"), (11, "solo")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = S.near_duplicates(df).collect()
    fp = {t: plain(t) for _, t in rows}
    want = roots(set(fp.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[want[fp[t]]] = min(i, least.get(want[fp[t]], i))
    expected = sorted((str(i), f"{fp[t]:016x}", least[want[fp[t]]]) for i, t in rows)
    hexed = S.near_duplicates(df).select("doc_id", S.hexadecimal(F.col("fp")).alias("h"), "component_id").collect()
    assert sorted((str(r.doc_id), r.h, r.component_id) for r in hexed) == expected and len(got) == len(rows)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(str(i) for i, t in rows if i is None or i == least[want[fp[t]]])


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are staged."""
    found, write = [], S.stage

    def stage(df, name="stage"):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(S, "stage", stage)
    monkeypatch.setattr(C, "stage", stage)
    return found


def test_no_join_trusts_the_estimated_size(spark, plans):
    """A cell has more rows than Spark sees in the files of fingerprints, a flipped one 65 times as many."""
    values = [int(np.uint64(v).astype(np.int64)) for v in clustered(7, 4, 20, 2)]
    words = [" ".join(f"w{i}" for i in range(k, k + 40)) for k in (0, 1, 90)]
    df = spark.createDataFrame([(i, words[i % 3]) for i in range(30)], "doc_id long, text string")
    C.components(S.links(spark.createDataFrame([(v,) for v in values], "fp long"), crowd=4)).count()
    plans.append(S.near_duplicates(df)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8 and not any("Broadcast" in p for p in plans)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y"), (3, "other words here", 7, "z"), (None, "a b c d", 8, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long, component_id string")
    out = S.keep_one(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_removed_ids_are_sent_out_only_where_they_are_few(spark, monkeypatch):
    rows = [(i, f"words of group {i % 4} and more", i) for i in range(24)] + [(None, "words of group 1 and more", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = sorted(map(tuple, S.keep_one(df).collect()), key=str)
    monkeypatch.setattr(S, "SENT", 100, raising=False)
    kept = S.keep_one(df)
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect()), key=str) == want == sorted([*rows[:4], rows[-1]], key=str)
