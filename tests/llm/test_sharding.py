from __future__ import annotations

import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest

from tablewright.llm import sharding as S


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 9, 6), (40, 3, 20), (0, 5, 3), (7, 0, 4), (10, 10, 0)])
def test_hypergeometric_law(good, bad, draws):
    rng = np.random.default_rng(1)
    n = 4_000
    seen = Counter(S.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(max(0, draws - bad), min(good, draws) + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    assert all(max(0, draws - bad) <= k <= min(good, draws) for k in seen)


def test_hypergeometric_of_very_many():
    rng = np.random.default_rng(2)
    draws = [S.hypergeometric(rng, 10**11, 23 * 10**11, 10**6) for _ in range(300)]
    assert abs(np.mean(draws) - 10**6 / 24) < 5 * 200 / 300**0.5


def test_matrix_margins():
    sizes = [0, 3, 17, 100, 1]
    m = S.matrix(sizes, 7, 3)
    assert m.sum(axis=1).tolist() == sizes and sorted(m.sum(axis=0).tolist()) == sorted(121 // 7 + (k < 121 % 7) for k in range(7)) and m.min() >= 0


def test_rows(spark):
    rows = [(i if i % 9 else None, None if i % 11 == 0 else "é" * (i % 5), "s") for i in range(1_000)] + [(5, "again", "t")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    got = S.assign(df, 24, carry=("doc_id", "text", "slot")).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.slot) for r in got) == Counter(rows)
    for r in got:
        raw = (r.row.text or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    # a group of copies spreads over the shards about as evenly as all rows
    hot = Counter(r.shard for r in got if r.row.text == "again")
    assert sum((hot[s] - 500 / 24) ** 2 / (500 / 24) for s in range(24)) < 60
    again = S.assign(df, 24, carry=("doc_id",)).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in again} == counts


def test_small_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in S.assign(df, 24).collect()) == [(0, 0), (1, 0)]
    assert S.assign(df.limit(0)).count() == 0
    S.write_shards(df, str(tmp_path / "shards"), 3)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "shards")).select("row.doc_id").collect()) == [1, 2]
