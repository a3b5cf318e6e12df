from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import secret_scan as S
from tests.conftest import SMALL


def base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def documents():
    rng = random.Random(9)
    words = ["the", "quick", "internationalisation", "andthentheylivedhappily", "brown", "écoute", "state-of-the-art-solution", "getElementByIdentifierName"]
    docs = [(0, None), (1, ""), (2, 'password = "hunter2hunter2" 🙂 Secret: abc token=token=abcdefgh12'), (3, "AKIA1234 AKIAABCDEFGHIJKL12"),
            (4, "é" * 50 + "0123456789abcdef" * 2 + " api_key: 'ABCDEFG1'  APIKEY=x"), (5, "secret: \"token\" : abcdefghijk"), (6, "a" * 40 + " " + "1" * 40),
            (7, "w " * 100_000 + "token = deadbeefdeadbeef"), (7, "passwd:12345678")]
    planted = {}
    for i in range(400):
        t = " ".join(rng.choice(words) for _ in range(60))
        if i % 4 == 0:
            x = base64.b64encode(rng.randbytes(30)).decode()
            at = len(t) // 2
            at = t.index(" ", at) + 1
            t = t[:at] + x + " " + t[at:]
            planted[1_000 + i] = (at, at + len(x))
        docs.append((1_000 + i, t))
    return docs, planted


def test_spans(spark):
    docs, planted = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string").repartition(4)
    out = S.find(df).select("doc_id", S.joined(F.col("spans")).alias("all"), S.joined(F.filter("spans", lambda s: s["kind"] != "random")).alias("base")).collect()
    assert sorted((r.doc_id, r.base) for r in out) == sorted((i, base(t)) for i, t in docs)
    found = {r.doc_id: r["all"] for r in out}
    hits = sum(f"random:{s}:{e}" in found[i] for i, (s, e) in planted.items())
    false = sum("random" in v for i, v in found.items() if i not in planted)
    assert hits >= 0.9 * len(planted) and false <= 0.1 * len(planted)


def test_empty(spark):
    assert S.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_battery(token, name):
    """The three tests written out symbol by symbol, and Fisher's sum of their logarithms."""
    symbols = dict(S.ENCODINGS)[name]

    def cell(c):
        if c in "0123456789":
            return "digit"
        return c.isupper(), "vowel" if c.lower() in "aeiou" else "frequent" if c.lower() in "tnsrhldc" else "rare"

    n = len(token)
    chi, cells = 0.0, {cell(c) for c in symbols}
    for k in cells:
        expected = n * sum(cell(c) == k for c in symbols) / len(symbols)
        chi += (sum(cell(c) == k for c in token) - expected) ** 2 / expected
    df = len(cells) - 1
    even = 0.5 * math.erfc(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)) / math.sqrt(2))
    kinds = [c.lower() in "aeiou" for c in token]
    a, b, runs = kinds.count(True), kinds.count(False), 1 + sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    p_runs = 1.0
    if a and b:
        mean = 1 + 2 * a * b / n
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    x = [symbols.index(c) for c in token]
    centre = sum(x) / n
    square = sum((v - centre) ** 2 for v in x)
    r = sum((u - centre) * (v - centre) for u, v in zip(x, x[1:], strict=False)) / square if square else 1.0
    serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    h = -math.log(max(even, 1e-300)) - math.log(max(p_runs, 1e-300)) - math.log(max(serial, 1e-300))
    return math.exp(-h) * (1 + h + h * h / 2)


def test_battery_against_plain_version():
    rng = random.Random(2)
    for name, symbols in S.ENCODINGS:
        code = [n for n, _ in S.ENCODINGS].index(name)
        few = symbols[:3] + symbols[-2:]
        for n in (20, 25, 40, 90):
            for _ in range(40):
                token = "".join(rng.choice(rng.choice([symbols, few])) for _ in range(n))
                x = np.array([symbols.index(c) for c in token])
                assert S.battery(x, code) == pytest.approx(plain_battery(token, name), rel=1e-6, abs=1e-12)


def test_battery_is_about_even_for_random_symbols():
    rng = np.random.default_rng(0)
    for code, (_, symbols) in enumerate(S.ENCODINGS):
        p = np.array([S.battery(rng.integers(0, len(symbols), 64), code) for _ in range(600)])
        assert 0.04 < (p < 0.1).mean() < 0.2 and (p > 0.5).mean() > 0.4
    for n in (40, 80):
        assert S.battery(np.arange(n) // 4 % 16, 0) < 1e-3 and S.battery(np.zeros(n, int), 0) < 1e-6


WORDS = """the quick brown fox jumps over lazy dog java script guide for beginners abstract singleton proxy factory bean report final version draft
get element by identifier name user account manager service handler request response configuration default provider builder internal exception message
listener thread pool executor cache entry iterator map reduce stream""".split()


def test_names_and_slugs_are_no_secrets(spark):
    """Among the given documents: CamelCase names, names with numbers and slugs stay out, planted tokens are found."""
    rng = random.Random(5)

    def name(n):
        return "".join(rng.choice(WORDS).capitalize() for _ in range(n))

    kinds = {"camel": [name(rng.randrange(5, 8)) for _ in range(200)] + ["TheQuickBrownFoxJumpsOver", "AbstractSingletonProxyFactoryBean", "JavascriptGuideForBeginners"],
             "slug": ["-".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 8))) for _ in range(200)],
             "number": [name(4) + str(rng.randrange(10_000)) for _ in range(200)] + ["Report2024FinalVersionDraft3"],
             "secret": [base64.b64encode(rng.randbytes(30)).decode() for _ in range(100)], "hex": [rng.randbytes(14).hex() for _ in range(60)]}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    planted = [(-1 - k, kind, f"some {t} there") for k, (kind, t) in enumerate((kind, t) for kind, ts in kinds.items() for t in ts)]
    extra = spark.createDataFrame([(i, t) for i, _, t in planted], "doc_id long, text string")
    found = {r.doc_id: any(s.kind == "random" for s in r.spans) for r in S.find(docs.unionAll(extra)).filter("doc_id < 0").collect()}
    share = {kind: sum(found[i] for i, k, _ in planted if k == kind) / len(ts) for kind, ts in kinds.items()}
    assert max(share["camel"], share["slug"], share["number"]) <= 0.05 and min(share["secret"], share["hex"]) >= 0.9, share


def plain_cut_offs(tokens, ordinary, rate):
    """The step-up rule over lists of single tokens."""
    out = {}
    for c in {c for c, _ in tokens}:
        own = sorted((b for k, b in tokens if k == c), reverse=True)
        null = [b for k, b in ordinary if k // 6 == c // 6 and k <= c]
        for rank, b in enumerate(own, 1):
            chance = (1 + sum(x >= b for x in null)) / (1 + len(null))
            if len(own) * chance <= rate * rank and (rank == len(own) or own[rank] != b):
                out[c] = b
    return out


def test_step_up_against_plain_version():
    rng = random.Random(8)
    for _ in range(50):
        tokens = [(rng.randrange(12), rng.randrange(20, 48)) for _ in range(rng.randrange(200))]
        ordinary = [(rng.randrange(12), rng.randrange(rng.choice([30, 45, 48]))) for _ in range(rng.randrange(2_000))]
        assert S.cut_offs(collections.Counter(tokens), collections.Counter(ordinary), 0.05) == plain_cut_offs(tokens, ordinary, 0.05)


def test_random_spans_against_plain_version(spark):
    """On the whole small table: the operator's random spans from single tokens and decoys."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    tokens, ordinary, own = [], [], {}
    for i, t in docs:
        ordinary += S.decoys(t)
        taken = [(s, e) for _, s, e in S.base_spans(t)]
        own[i] = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
            code = S.encoding_of(m[0])
            if len(m[0]) >= 20 and code and not any(s < m.end() and m.start() < e for s, e in taken):
                p = plain_battery(code[1], S.ENCODINGS[code[0]][0])
                c = code[0] * 6 + sum(len(code[1]) >= x for x in (20, 24, 32, 40, 56, 80)) - 1
                own[i].append((m.start(), m.end(), c, max(0, min(47, 47 + math.floor(4 * math.log10(p)))) if p > 0 else 0))
        tokens += [(c, b) for *_, c, b in own[i]]
    least = plain_cut_offs(tokens, ordinary, 0.05)
    want = {i: [(s, e) for s, e, c, b in found if b >= least.get(c, 48)] for i, found in own.items()}
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in S.find(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert got == want


def test_step_up():
    decoys = {(0, 5): 99, (1, 45): 50, (6, 46): 90}
    least = S.cut_offs({(0, 45): 30, (0, 3): 5, (1, 44): 10, (12, 47): 9}, decoys, 0.05)
    assert least == {0: 45}
    assert S.cut_offs({}, {}, 0.05) == {}


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(base("").encode()).hexdigest()
