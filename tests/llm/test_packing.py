from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing as P
from tablewright.llm.queries import tokenizer_file

ODD = ["", " ", "\n", "a  b", "a\n\nb", " a", "a ", "a\tb", "a b", "x <|endoftext|> y", "x<|endoftext|>y z", "don't stop's", "a\r\nb  \n c", "\x1c a",
       "12 34,5!!  ?", "naïve Ünder ß 东京 タワー 🙂 ok", "a" * 5_000, "a b c", "we'll 'tis I'm", "\n\n\nx", "tab\t\tend ", "x\x85y z"]


def test_encoder_equals_the_tokenizer():
    path = tokenizer_file()
    own, plain = P.Encoder(path), Tokenizer.from_file(path)
    for text in [*ODD, *(f"{a} {b}\n{a}" for a in ODD for b in ODD)]:
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def check(pieces, window):
    """Pieces (sequence, offset, length): gapless sequences, padded nowhere."""
    by: dict[int, list] = {}
    for s, o, n in pieces:
        by.setdefault(s, []).append((o, n))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at == window or at & (at - 1) == 0 and at < window


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    window = [8, 16, 64, 256][seed % 4]
    counts = np.zeros(window, np.int64)
    if seed < 8:
        counts[1:] = rng.integers(0, 30, window - 1) * (rng.random(window - 1) < rng.random())
    else:  # nearly all of one length
        counts[rng.integers(1, window)] = 5_000
        counts[rng.integers(1, window)] += 3
    plan = P.plan(counts, window)
    length = np.repeat(np.arange(window), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    out = [np.stack([i, b, t, s, o]) for i, b, t, s, o, _ in plan.place(length, rank)]
    if not out:
        return
    index, begin, take, sequence, offset = np.concatenate(out, axis=1)
    check(zip(sequence.tolist(), offset.tolist(), take.tolist(), strict=True), window)
    assert np.bincount(index, take, len(length)).tolist() == length.tolist() and len(set(zip(index.tolist(), begin.tolist(), strict=True))) == len(index)
    assert len(np.unique(sequence)) == plan.sequences


def test_best_fill_is_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        left = np.zeros(40, np.int64)
        left[1:] = rng.integers(0, 3, 39) * (rng.random(39) < 0.1)
        room = int(rng.integers(1, 40))
        sums = {0}
        for n in np.repeat(np.arange(40), left).tolist():
            sums |= {s + n for s in sums if s + n <= room}
        picked = P.best_fill(left, room)
        assert sum(n * k for n, k in picked.items()) == max(sums) and all(k <= left[n] for n, k in picked.items())


@pytest.mark.parametrize("window", [16, 2_048])
def test_documents(spark, window):
    texts = [*ODD, None, "same words here", "same words here", *["the cat sat on the mat " * k for k in (1, 7, 40, 300)], *["of copies"] * 50]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(1, "twice", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(3)
    path = tokenizer_file()
    got = P.pack(df, path, window).collect()
    check([(r.sequence_id, r.offset, r.length) for r in got], window)
    plain = Tokenizer.from_file(path)
    want: dict = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
    for i, docs in want.items():
        own = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert sum(x[2] for x in own) == sum(map(len, docs))
        for n, start, size, crc in own:
            assert any(len(d) == n and zlib.crc32(np.array(d[start:start + size], "<u4")) == crc for d in docs)
    sequences = {r.sequence_id: r.ids for r in P.packed_ids(df, path, window).collect()}
    for r in got:
        assert zlib.crc32(np.array(sequences[r.sequence_id][r.offset:r.offset + r.length], "<u4")) == r.ids_crc32


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0
