from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewright.llm import toxicity as X
from tests.conftest import SMALL

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy():
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    rows = [(r["doc_id"], r["text"].encode(), labels[r["doc_id"]]) for r in docs if r["doc_id"] in labels]
    rows.sort(key=lambda r: zlib.crc32(b"%d" % r[0]))
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    scorer = X.fit([r[1] for r in learn], np.array([r[2] for r in learn])).scorer()
    s, y = np.array([scorer.score(r[1]) for r in test]), np.array([r[2] for r in test])
    ranks = s.argsort().argsort()
    auc = (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95 and (s[y == 1] >= 0.5).mean() >= 0.9 and (s[y == 0] < 0.5).mean() >= 0.98


def toy(n=300):
    rng = np.random.default_rng(3)
    voc = [f"word{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(n):
        w = [voc[k] for k in rng.integers(0, 80, rng.integers(5, 60))]
        if i % 4 == 0:
            w.insert(int(rng.integers(0, len(w))), ["vilest", "vilething", "grubby"][i // 4 % 3])
        texts.append(" ".join(w).encode())
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return X.fit(*toy())


def test_whole_texts_and_forms(model):
    s = model.scorer()
    assert s.score(b"word1 " * 200_000 + b"vilest") >= 0.5 > s.score(b"word1 " * 200_000)
    assert s.score(b"WORD3, %%VILEST%% word4") >= 0.5 and s.score(b"word2 vilexyz word9") != s.score(b"word2 word9")
    assert s.score(None) == s.score(b"") == s.score(b" \n") < 0.5
    again = model.scorer()
    assert [again.score(t) for t in toy()[0][:20]] == [s.score(t) for t in toy()[0][:20]]


def test_language():
    assert X.language_of(X.words_of(b"der Hund und die Katze")) == 1 and X.language_of([b"zzz"]) == len(X.FUNCTION_WORDS)


def test_without_both_classes():
    assert X.fit([b"a"], np.array([1])).scorer().score(b"x") == 1.0 and X.fit([], np.zeros(0)).scorer().score(b"x") == 0.0


def test_tables(spark):
    texts, y = toy(120)
    rows = [(i, t.decode(), int(v)) for i, (t, v) in enumerate(zip(texts, y, strict=True))]
    odd = [(None, "vilest", None), (500, None, 1), (501, "", 0), (502, "grubby vilest", None), (502, "grubby vilest", None)]
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows + odd], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, v) for i, _, v in rows + odd] + [(0, 1), (0, 1), (None, 1), (7, 5)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = X.score(docs, model).select("doc_id", X.held_out(F.col("doc_id")).alias("h"), "score", "predicted").collect()
    assert len(got) == len(rows) + len(odd)
    scorer, by_id = model.scorer(), {i: t for i, t, _ in rows + odd}
    for r in got:
        t = by_id[r.doc_id]
        assert r.score == pytest.approx(scorer.score(None if t is None else t.encode()), abs=1e-6) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = X.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    empty = X.train(docs.limit(0), labels.limit(0))
    assert X.score(docs.limit(0), empty).count() == 0 and X.keep_clean(docs.limit(0), empty).count() == 0


def test_held_out_labels_change_nothing(spark):
    texts, y = toy(120)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    right = [(i, int(v)) for i, v in enumerate(y)]
    turned = [(i, v if zlib.crc32(str(i).encode()) % 5 else 1 - v) for i, v in right]
    a, b = (X.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).scorer() for rows in (right, turned))
    assert [a.score(t) for t in texts] == [b.score(t) for t in texts]


def test_long_rows_are_passed_over(spark, monkeypatch):
    ids = [r[0] for r in spark.range(1, 60).filter(~X.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    docs = spark.createDataFrame([(i, "w" * 50_000 if i == ids[0] else f"text {i}") for i in ids] + [(ids[1], f"text {ids[1]}")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "fit", lambda texts, truth, **_: seen.append((sorted(texts), set(truth.tolist()))))
    X.train(docs, labels, sample_bytes=20_000)
    assert seen == [(sorted(f"text {i}".encode() for i in [*ids[1:], ids[1]]), {0, 1})]


def test_labels_of_one_kind(spark):
    """Without both kinds every score is the share of toxic labels; ids may be text."""
    docs = spark.createDataFrame([(f"d{i}", f"text {i}", i) for i in range(40)], "doc_id string, text string, size int")
    for label, score in ((0, 0.0), (1, 1.0)):
        labels = spark.createDataFrame([(f"d{i}", label, "m") for i in range(50)], "doc_id string, toxic int, mark string")
        assert {r.score for r in X.score(docs, X.train(docs, labels)).collect()} == {score}


def test_sample_by_class(spark, monkeypatch):
    """A rare kind is in the sample, however many rows the other has."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5_000 == 7).cast("int").alias("toxic"))
    seen = []
    monkeypatch.setattr(X, "fit", lambda texts, truth, **_: seen.append((len(texts), int(truth.sum()), texts)))
    X.train(docs, labels, sample_rows=200)
    X.train(docs.repartition(7), labels.repartition(3), sample_rows=200)
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").filter(~X.held_out(F.col("doc_id"))).count()
    assert seen[0][:2] == (150 + toxic, toxic) and toxic >= 2 and seen[0] == seen[1]


def plain_score(m, text):
    """The classifier's layers one after the other, without tables of words."""
    words = X.words_of(text)
    vectors = []
    for w in words:
        own = [m.rows[f] for f in X.features(w, m.buckets) if f in m.rows]
        vectors.append(m.embed[own].sum(axis=0) if own else np.zeros(m.embed.shape[1]))
    widest = max(m.filters)
    vectors = np.array((vectors or [np.zeros(m.embed.shape[1])]) + [np.zeros(m.embed.shape[1])] * (widest - 1), float)
    pooled = []
    for width in sorted(m.filters):
        kernel = m.filters[width]
        out = [sum(vectors[i + j] @ kernel[j] for j in range(width)) for i in range(len(vectors) - widest + 1)]
        pooled.append(np.max(out, axis=0) + m.bias[width])
    votes = [sum(w.decode("utf-8", "replace") in ws for w in words) for ws in X.FUNCTION_WORDS]
    language = int(np.argmax(votes)) if any(votes) else len(votes)
    logit = np.maximum(np.concatenate(pooled), 0) @ m.out + m.out_bias - m.shift[language]
    return 1 / (1 + np.exp(-logit))


def test_against_direct_convolution(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in X.score(docs, model).collect():
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-5)


def test_every_labelled_row_counts(spark):
    """All rows are learned from, however many and however long: the model is that of all texts in one place."""
    n = 9_000
    texts = [f"word{i % 61} " + ("vilest" if i % 3 == 0 else f"word{i % 17}") for i in range(n)]
    ids = [i for i in range(n) if zlib.crc32(b"%d" % i) % 5]
    toxic = {i: int(i % 3 == 0) for i in ids}
    long = ids[5]
    texts[long], toxic[long] = "word1 " * 700_000 + "vilest", 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    got, want = X.train(docs, labels), X.fit([texts[i].encode() for i in ids], np.array([toxic[i] for i in ids]))
    assert got.rows == want.rows and got.rows
    assert (got.embed == want.embed).all() and (got.out == want.out).all() and (got.shift == want.shift).all()


def test_shortened_texts_meet_the_same_stretches():
    """What stays of a text for training gives the layers' maxima of the whole text."""
    rows = {f: k for k, f in enumerate(sorted({X.features(w, 1 << 22)[0] for w in (b"aa", b"bb", b"der")}))}
    rng = np.random.default_rng(1)
    layers = X._Layers(rng.normal(size=(3, 4)), {w: rng.normal(size=(w, 4, 5)) for w in (1, 2, 3)}, {w: np.zeros(5) for w in (1, 2, 3)}, np.ones(15), np.zeros(1))
    model = X.ToxicityModel(1 << 22, rows, layers.embed, layers.filters, layers.bias, layers.out, 0.0)
    texts = [" ".join(rng.choice(["aa", "bb", "der", "x", "y", "z"], rng.integers(0, 40))).encode() for _ in range(200)] + [b"aa", b"", b"aa bb x x x x", b"x x x x aa"]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([0] * len(texts), pa.int32()), pa.array([False] * len(texts))], names=["text", "toxic", "hold"])
    read, = X._read([batch], rows, 1 << 22, 3)
    logit = layers.forward(read)[-1]
    assert [1 / (1 + np.exp(-v)) for v in logit] == pytest.approx([plain_score(model, t) for t in texts], abs=1e-9)
