from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tablewright.llm import decontaminate, simhash, toxicity
from tablewright.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"


def plain(docs, labels, items):
    """The stages in plain Python over rows (doc_id, text)."""
    known = sorted((i, x) for i, x in labels.items() if zlib.crc32(str(i).encode()) % 5)
    texts = dict(docs)
    model = toxicity.fit([(texts[i] or "").encode() for i, _ in known if i in texts], np.array([x for i, x in known if i in texts]))
    scorer = model.scorer()
    rows = [(i, t) for i, t in docs if scorer.score((t or "").encode()) < 0.5]
    first: dict[str, int] = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first[key] = min(i, first.get(key, i))
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    rows = [(i, t) for i, t in rows if root(i) == i]
    wanted = {j: decontaminate.shingles(decontaminate.words_of(q.encode()), 5) for j, q in items}
    return [(i, t) for i, t in rows
            if not any(len(q & decontaminate.shingles(decontaminate.words_of((t or "").encode()), 5)) >= 0.8 * len(q) for q in wanted.values())]


def test_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = plain(docs, labels, items)
    assert 20 < len(kept) < len(docs)
    got = pipeline.run(spark, SMALL).collect()
    encode = Tokenizer.from_file(tokenizer_file())
    want = {i: [*encode.encode(t or "", add_special_tokens=False).ids, 1] for i, t in kept}
    assert {r.doc_id for r in got} == set(want)
    for i, ids in want.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert [s for s, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1].tolist()] and sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[s:s + n], "<u4")) == c for s, n, c in own)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    odd = [(1, "the cat", None, "s", 7), (2, "the  cat", "en", None, None), (3, None, None, None, 0), (4, "", "en", "s", 0), (5, "word " * 30_000, "en", "s", 1), (5, "word " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        rows.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        step = spark.read.parquet(str(tmp_path / "documents.parquet"))
        for k, (_, f) in enumerate(pipeline.STAGES[:-1]):
            out = f(spark, step, str(tmp_path))
            assert out.columns == docs.columns
            out.write.mode("overwrite").parquet(str(tmp_path / f"step{k}"))
            step = spark.read.parquet(str(tmp_path / f"step{k}"))
        ids = sorted(r.doc_id for r in step.select("doc_id").collect())
        assert ids in ([1, 3, 5], []) and pipeline.run(spark, str(tmp_path)).filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().count() == len(ids)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert {"op1_exact_dedup", "op5_warc", "op9_decontamination"} <= set(entry.oracle_sql()) <= set(names)
