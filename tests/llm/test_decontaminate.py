from __future__ import annotations

import random
import re

import pytest

from tablewright.llm import decontaminate as D


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]


def brute(docs, items, size=5, threshold=0.8):
    out = []
    for i, t in docs:
        for j, q in items:
            qs = words(q)
            n = min(size, len(qs))
            own = {tuple(qs[k:k + n]) for k in range(len(qs) - n + 1)} if n else set()
            ws = words(t)
            have = {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)}
            if own and len(own & have) >= threshold * len(own) - 1e-9:
                out.append((str(i), j, len(own & have), len(own)))
    return sorted(out)


def cases():
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 2, 4, 5, 6, 12, 30])))) for k in range(25)]
    items += [(25, ""), (26, None), (27, "same same same same same same same"), (28, items[3][1])]
    docs = [(None, None), (0, ""), (1, "Same! same, same same same")]
    for k in range(60):
        t = [rng.choice(voc) for _ in range(rng.randrange(200))]
        q = words(rng.choice(items)[1])
        if k % 2 and q:
            cut = [w if rng.random() > 0.03 else "zz" for w in q]
            t[10:10] = cut
        docs.append((k + 2, (", " if k % 3 else "\n").join(t).upper() if k % 5 == 0 else " ".join(t)))
    docs += [(100, " ".join(rng.choice(voc) for _ in range(60_000)) + " " + items[6][1]), (5, items[5][1]), (5, items[5][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1, 200, 8 << 20])
def test_against_brute_force(spark, block_bytes):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    if block_bytes == 1:
        bench, items = bench.filter("item_id < 8"), items[:8]
    got = D.contaminated(df, bench, block_bytes=block_bytes).collect()
    want = brute(docs, items)
    assert want and sorted((str(r.doc_id), r.item_id, r.shared, r.item_shingles) for r in got) == want
    kept = D.keep_uncontaminated(df, bench, block_bytes=block_bytes)
    gone = {w[0] for w in want}
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in gone)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0 and D.keep_uncontaminated(docs, none).count() == 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], none.schema)).count() == 0


def test_sketch_is_long_enough():
    for n in range(1, 200):
        assert D.sketch_size(n, 0.8) + D.needed(n, 0.8) == n + 1
