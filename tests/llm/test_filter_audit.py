from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from tablewright.llm import filter_audit as A


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    return out + ("D" if any(c in "#$%&*|" for c in text) else "")


def plain(docs, labels):
    """Every order over every document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    ids = {}
    for i, text, _ in docs:
        if i is not None:
            ids.setdefault(text or "", []).append(i)
    rows, shares = {}, {}
    for i, text, lang in docs:
        fails = failed(text or "") + ("E" if i is not None and i > min(ids[text or ""]) else "")
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = rows.setdefault((lang or "", order, step), [0] * 6)
                hit = f in fails
                here = hit and not gone
                row[0] += not hit and not gone
                row[1] += here
                row[2] += hit and gone
                row[3] += fails == f
                row[4] += here and i in good
                row[5] += here and i in toxic
                shares[lang or "", f] = shares.get((lang or "", f), 0) + here
                gone = gone or hit
    return {(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


DOCS, LABELS = "doc_id long, text string, lang string, part string, mask int, n long", "doc_id long, quality int, toxic int, good int"


def documents(seed, n=300):
    rng = random.Random(seed)
    pool = ["", None, "x", "Ab " * 120, "#tag", "A B C D E", "é" * 20 + "Q" * 3, "é" * 27 + "Q" * 3, "é" * 26 + "Q" * 3, " ".join(map(str, range(100))), " ".join(map(str, range(99))),
            " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), "w w " * 100, "long " * 50_000]
    pool += [" ".join(rng.choice(["a", "b", f"n{i}", "Zed", "50%"]) + str(rng.randrange(200)) for i in range(rng.choice([20, 100, 150]))) for _ in range(30)]
    docs = [(rng.choice([None, *range(n)]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    docs += [(10**6 + i, "the same text", "en") for i in range(n // 3)] + [(10**6, "the same text", "en"), (10**6, "the same text", "fr")]
    labels = [(rng.choice([None, *range(n)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)] + [(10**6 + 1, 1, 1)] * 2
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_order(spark, seed):
    docs, labels = documents(seed)
    d = spark.createDataFrame([(*r, "p", 3, 4) for r in docs], DOCS).repartition(5)
    rows = A.audit(d, spark.createDataFrame([(*r, 9) for r in labels], LABELS)).collect()
    assert {tuple(r) for r in rows} == plain(docs, labels)
    assert len(rows) == 600 * len({lang or "" for _, _, lang in docs})


def test_shares_add_up(spark):
    docs, labels = documents(3)
    rows = A.audit(spark.createDataFrame([(*r, "p", 3, 4) for r in docs], DOCS), spark.createDataFrame([(*r, 9) for r in labels], LABELS)).collect()
    removed = sum(r.removed for r in rows if r.part == "en")
    assert removed == sum(r.shapley for r in rows if r.part == "en" and r.filter_order == "ABCDE")


def test_other_filters(spark):
    """The folds know nothing of texts: any cells of up to six filters."""
    counted = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 2, 1), ("p", 3, 4, 0, 4)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.interactions(counted, "XY").collect()}
    assert rows == {("XY", 1): (5, 6, 0, 2, 2, 5, 8), ("XY", 2): (5, 0, 4, 0, 0, 0, 4), ("YX", 1): (7, 4, 0, 0, 0, 4, 4), ("YX", 2): (5, 2, 4, 2, 2, 1, 8)}
    with pytest.raises(ValueError):
        A.interactions(counted, "XX")


def test_empty(spark):
    assert A.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    one = A.audit(spark.createDataFrame([(None, None, None, None, None, None)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)
