from __future__ import annotations

import hashlib
import re

import pytest

from tablewright.llm import exact_dedup as X

ROWS = [(5, "a b"), (3, "a\t\n b"), (9, "a  b"), (None, "a b"), (7, None), (2, ""), (1, "c"), (1, "c"), (4, " c"), (8, "\x0b\x1cd"), (6, "e" * 200_000),
        (10, "é b"), (11, "é b"), (None, "lone"), (12, "A b")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, digest long, keep_id string").repartition(3)


@pytest.mark.parametrize("share", [1 / 2_000, 0.2])
def test_against_brute_force(spark, share):
    rows = ROWS + [(100 + i, "hot  text") for i in range(40)]
    got = X.dedup(frame(spark, rows), share).collect()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("share", [1 / 2_000, 0.2])
def test_first_rows_stay(spark, share):
    rows = ROWS + [(100 + i, "hot  text") for i in range(40)]
    out = X.keep_first(frame(spark, rows), share)
    assert out.columns == ["doc_id", "text", "digest", "keep_id"]
    got = out.collect()
    assert len({norm(r.text) for r in got}) == len(got) == len({norm(t) for _, t in rows})
    for r in got:
        ids = [i for i, t in rows if norm(t) == norm(r.text)]
        assert r.doc_id == min((i for i in ids if i is not None), default=None) and r.digest == r.doc_id


def test_empty(spark):
    assert X.dedup(frame(spark, ROWS).limit(0)).count() == 0 and X.keep_first(frame(spark, ROWS).limit(0)).count() == 0


def test_misra_gries_bounds(spark):
    items = ["a"] * 300 + ["b"] * 150 + [f"x{i}" for i in range(550)]
    df = spark.createDataFrame([(x.encode(),) for x in items], "item binary").repartition(5)
    low = {bytes(r.item).decode(): r.low for r in X.misra_gries(df, "item", 19).collect()}
    for item, n in (("a", 300), ("b", 150)):
        assert n - len(items) / 20 <= low[item] <= n
    assert all(n <= items.count(x) for x, n in low.items())
