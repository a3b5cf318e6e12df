"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines with letters or digits in them; comment marks count for nothing.
Paragraphs that hold none of the anchor words are no licence statements. The others are read in
overlapping windows of words, and line by line, and each such piece is scored by a sparse logistic regression over the word n-grams of the
templates. It is trained, in numpy on the driver, on statements made from the templates
(words left out, words of the corpus around and between them) and, of the class ``unknown``, on
lines of the corpus from a bounded sample, on statements of made-up licences and on near
misses: templates with the words that name their licence exchanged, and identifiers of other
licences. The least probability that counts is set on statements kept out of training, so that
at most ``false_rate`` of unknown ones, near misses included, pass. A family is confirmed when
enough of a template's word pairs occur in the paragraph, and enough of those that no other
family's template has. Scoring is DataFrame functions alone: n-grams meet the weights
(a table of at most ``MOST_FEATURES`` rows) in a broadcast join.

Defined results: null and empty texts have no paragraphs; repeated rows are reported each;
``line`` is the first line of the paragraph, ``probability`` the family's against unknown,
by the n-grams of its own templates;
a paragraph below the least probability or without a confirming template is ``unknown``.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.shared import stage

# Short statements and opening words of public licences.
STATEMENTS = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights under cc0 1 0 universal public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "copyright all rights reserved no part may be reproduced without prior written permission"),
)
# Licence identifiers of the families, and some of other licences.
IDENTIFIERS = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "gpl": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "lgpl": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "agpl": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "bsd": "BSD-2-Clause BSD-3-Clause", "mpl-2.0": "MPL-2.0", "isc": "ISC", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nd": "CC-BY-ND-4.0",
    "cc0": "CC0-1.0", "unlicense": "Unlicense",
}
OTHER_IDENTIFIERS = "EPL-2.0 Zlib BSL-1.0 Artistic-2.0 EUPL-1.2 OFL-1.1 WTFPL PostgreSQL MS-PL AFL-3.0 OSL-3.0 CECILL-2.1 Apache-1.1 MPL-1.1 GPL-1.0-only MIT-0 BSD-4-Clause CC-BY-3.0 CC-BY-NC-ND-4.0 NCSA".split()


def _identified(identifier: str) -> str:
    return "spdx license identifier " + " ".join(re.split(r"[^a-z0-9]+", identifier.lower())) + " spdxend"


TEMPLATES = (*STATEMENTS, *((family, _identified(x)) for family, ids in IDENTIFIERS.items() for x in ids.split()))
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
ANCHOR = r"(?i)licen[cs]e|permission|redistribut|copyright|public domain|creative commons|warrant|spdx"
_WORDS = r"[^a-z0-9]+"
SIZES = (1, 2, 3)
#: Words of a window; each begins half a window after the one before.
WINDOW = 64
MOST_FEATURES = 5_000
#: Least share of a template's word pairs.
CONFIRM = 0.6


def ngrams(words: list[str], sizes=SIZES) -> set[str]:
    return {" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1)}


@dataclass
class LicenceModel:
    features: dict[str, int]
    weights: np.ndarray  # (features, classes); the last class is unknown
    bias: np.ndarray
    least: float  # among all classes
    least_own: float  # of one family against unknown alone

    def own(self) -> np.ndarray:
        """Weights of each family against unknown, on the n-grams of its own templates: what another statement says is left out."""
        mask = np.zeros((len(self.features), len(FAMILIES)))
        for family, text in TEMPLATES:
            for g in ngrams(text.split()):
                if g in self.features:
                    mask[self.features[g], FAMILIES.index(family)] = 1
        return mask * (self.weights[:, :-1] - self.weights[:, -1:])


def exclusive(number: int) -> set[str]:
    """Word pairs of a template that no template of another family has."""
    family, text = TEMPLATES[number]
    return ngrams(text.split(), (2,)) - {g for f, t in TEMPLATES if f != family for g in ngrams(t.split(), (2,))}


_EXCLUSIVE = [exclusive(k) for k in range(len(TEMPLATES))]


def _near_miss(rng: random.Random, filler: list[str]) -> list[str]:
    """A template without any of the pairs that set its family apart."""
    k = rng.randrange(len(TEMPLATES))
    words = TEMPLATES[k][1].split()
    for i in range(len(words) - 1):
        if f"{words[i]} {words[i + 1]}" in _EXCLUSIVE[k]:
            words[i + (rng.random() < 0.5)] = rng.choice(filler)
    return words


def _made(rng: random.Random, filler: list[str]) -> tuple[list[str], int]:
    """A statement made from a template, or of another or a made-up licence (class: one past the families)."""
    def fill(n):
        return [rng.choice(filler) for _ in range(rng.randrange(n + 1))]

    kind = rng.random()
    if kind < 0.55:
        # The families alike, and within one its templates.
        family = rng.choice(FAMILIES)
        text = rng.choice([t for f, t in TEMPLATES if f == family])
        return fill(6) + [w for w in text.split() if rng.random() > 0.06] + fill(6), FAMILIES.index(family)
    if kind < 0.75:
        return fill(6) + _near_miss(rng, filler) + fill(6), len(FAMILIES)
    if kind < 0.85:
        made = "-".join(rng.choice(filler) for _ in range(rng.randrange(1, 3))) + f"-{rng.randrange(1, 5)}.{rng.randrange(3)}"
        return fill(6) + _identified(rng.choice([*OTHER_IDENTIFIERS, made])).split() + fill(6), len(FAMILIES)
    frame = rng.choice(("licensed under the {} license version {}", "released under the {} license", "this work is licensed under the {} public license",
                        "copyright {} {}", "permission of the {} is needed", "the {} license terms apply", "without warranty of {}"))
    text = frame.format(" ".join(rng.choice(filler) for _ in range(rng.randrange(1, 4))), rng.randrange(1, 9))
    return fill(6) + text.split() + fill(6), len(FAMILIES)


def fit(lines: list[str], *, statements: int = 2_400, steps: int = 150, false_rate: float = 0.01, seed: int = 3) -> LicenceModel:
    """Train on made statements and on ``lines`` of the corpus that hold no anchor word (class unknown)."""
    rng = random.Random(seed)
    filler = sorted({w for x in lines for w in x.split()}) or ["thing", "other", "any", "work", "house", "green"]
    rows = [_made(rng, filler) for _ in range(statements)]
    rows += [(x.split()[:200], len(FAMILIES)) for x in lines]
    rng.shuffle(rows)
    names = sorted({g for _, t in TEMPLATES for g in ngrams(t.split())})
    if len(names) > MOST_FEATURES:
        raise ValueError("the templates have more n-grams than a broadcast may hold")
    features = {g: k for k, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (words, _) in enumerate(rows):
        for g in ngrams(words):
            k = features.get(g)
            if k is not None:
                x[i, k] = 1
    y = np.array([c for _, c in rows])
    held = np.arange(len(rows)) % 3 == 2
    w, b = np.zeros((len(names), len(FAMILIES) + 1)), np.zeros(len(FAMILIES) + 1)
    target = np.eye(len(FAMILIES) + 1)[y[~held]]
    seen_w, seen_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        p = _softmax(x[~held] @ w + b)
        g = x[~held].T @ (p - target) / len(target) + 1e-5 * w
        h = (p - target).mean(axis=0)
        seen_w += g * g
        seen_b += h * h
        w -= 0.3 * g / np.sqrt(seen_w + 1e-10)
        b -= 0.3 * h / np.sqrt(seen_b + 1e-10)
    unknown = x[held][y[held] == len(FAMILIES)]
    model = LicenceModel(features, w, b, 0.5, 0.5)
    p, own = _softmax(unknown @ w + b)[:, :-1].max(axis=1, initial=0), 1 / (1 + np.exp(-(unknown @ model.own() + b[:-1] - b[-1]).max(axis=1, initial=-np.inf)))
    if len(unknown):
        model.least, model.least_own = (float(np.quantile(v, 1 - false_rate)) for v in (p, own))
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _plain(text):
    """Words in lower case, one spelling of licence, and a mark behind a licence identifier."""
    low = F.regexp_replace(F.lower(text), "licence", "license")
    low = F.regexp_replace(low, r"spdx-license-identifier: *([a-z0-9.+-]+)", "spdx license identifier $1 spdxend ")
    return F.trim(F.regexp_replace(low, _WORDS, " "))


def train(docs: DataFrame, sample_rows: int = 400, line_bytes: int = 2_000, **options) -> LicenceModel:
    """Fit with one line each of the ``sample_rows`` documents whose ids hash lowest (lines cut at ``line_bytes`` for the sample).

    Tasks send only lines below a hash bound, which follows from the number of documents.
    """
    named = docs.filter("text is not null and doc_id is not null")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = int(min(1.0, 4 * (sample_rows + 100) / max(1, named.count())) * (1 << 30))
    lines = (named.filter(at < bound).select("doc_id", F.substring(F.substring_index("text", "\n", 1), 1, line_bytes).alias("line"))
             .filter(~F.col("line").rlike(ANCHOR)).orderBy(at, "doc_id", "line").limit(sample_rows))
    return fit([r[0] for r in lines.select(_plain(F.col("line"))).collect()], **options)


def _weights(spark: SparkSession, model: LicenceModel) -> DataFrame:
    weights = np.hstack([model.weights, model.own()])
    rows = [(g, [float(v) for v in weights[k]]) for g, k in model.features.items()]
    rows.append(("", [0.0] * (2 * len(FAMILIES) + 1)))  # so that no paragraph is lost
    return spark.createDataFrame(rows, "gram string, weights array<double>")


def _pairs(spark: SparkSession) -> DataFrame:
    """One row for each word pair of each template: ``pair`` is its number, ``pairs`` are those of the whole template, ``own`` those of its family alone."""
    of = [sorted(ngrams(t.split(), (2,))) for _, t in TEMPLATES]
    number = {g: k for k, g in enumerate(sorted({g for grams in of for g in grams}))}
    rows = [(g, number[g], i, FAMILIES.index(f), [number[x] for x in of[i]], [number[x] for x in sorted(_EXCLUSIVE[i])]) for i, (f, _) in enumerate(TEMPLATES) for g in of[i]]
    return spark.createDataFrame(rows, "gram string, pair int, template int, family int, pairs array<int>, own array<int>")


def _paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, line, lines``: runs of lines with letters or digits, in plain words, that hold an anchor word."""
    anywhere = ANCHOR.replace(" ", "[^a-z0-9]+")  # two words may stand on two lines
    lines = docs.filter(F.col("text").rlike(anywhere)).select("doc_id", F.split("text", "\n").alias("lines"))
    lines = lines.withColumn("full", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    filled = lambda i: F.coalesce(F.get("full", i), F.lit(False))
    firsts, lasts = F.filter(at, lambda i: filled(i) & ~filled(i - 1)), F.filter(at, lambda i: filled(i) & ~filled(i + 1))
    cut = lines.select("doc_id", "lines", F.explode(F.arrays_zip(firsts.alias("first"), lasts.alias("last"))).alias("run"))
    own = F.slice("lines", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1)
    out = cut.select("doc_id", F.col("run.first").alias("line"), F.transform(own, _plain).alias("lines"))
    return out.filter(F.array_join("lines", " ").rlike(ANCHOR))


def _pieces(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, line, at, piece, w``: the windows and the lines of each paragraph that hold an anchor word, as words."""
    words = F.filter(F.split(F.array_join("lines", " "), " "), lambda x: x != "")
    read = paragraphs.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "line", "at", "lines", words.alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - WINDOW // 2 - 1), F.lit(WINDOW // 2))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, WINDOW), " "))
    # Pieces as text: equal ones are found by hash, so long paragraphs take time in proportion.
    pieces = F.filter(F.array_distinct(F.concat(windows, "lines")), lambda x: x.rlike(ANCHOR))
    return read.select("doc_id", "line", "at", F.posexplode(pieces).alias("piece", "x")).select("doc_id", "line", "at", "piece", F.split("x", " ").alias("w"))


def scan(docs: DataFrame, model: LicenceModel, confirm: float = CONFIRM) -> DataFrame:
    """``doc_id, line, family, probability, similarity`` of every paragraph with an anchor word and every family confirmed in it."""
    spark = docs.sparkSession
    # Only n-grams of the templates count, so long paragraphs leave few.
    grams = F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *[F.expr(
        f"case when size(w) >= {n} then transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')) else array() end") for n in SIZES])))
    from_words = _pieces(_paragraphs(docs)).select("doc_id", "line", "at", "piece", F.explode(grams).alias("gram"))
    classes = len(FAMILIES) + 1
    sums = [F.sum(F.col("weights")[c]).alias(f"w{c}") for c in range(2 * classes - 1)]
    met = stage(from_words.join(F.broadcast(_weights(spark, model)), "gram"), "grams")
    scored = met.groupBy("at", "piece", "doc_id", "line").agg(*sums)
    logits = F.array(*[F.col(f"w{c}") + float(model.bias[c]) for c in range(classes)])
    alone = F.array(*[F.col(f"w{classes + c}") + float(model.bias[c] - model.bias[-1]) for c in range(classes - 1)])
    scored = scored.select("at", "piece", "doc_id", "line", logits.alias("z"), alone.alias("alone"))
    shared = (met.select("at", "piece", "gram").join(F.broadcast(_pairs(spark)), "gram").groupBy("at", "piece", "template")
              .agg(F.first("family").alias("family"), F.first("pairs").alias("pairs"), F.first("own").alias("alone"), F.collect_set("pair").alias("has"))
              .filter((F.size("has") >= confirm * F.size("pairs")) & (F.size(F.array_intersect("has", "alone")) >= confirm * F.size("alone")))
              .groupBy("at", "piece").agg(F.collect_list(F.struct("template", "family", "pairs", "has")).alias("like")))
    shared = shared.withColumnRenamed("at", "like_at").withColumnRenamed("piece", "like_piece")
    rows = scored.join(shared, (F.col("at") == F.col("like_at")) & (F.col("piece") == F.col("like_piece")), "left")
    total = F.aggregate(F.transform("z", lambda v: F.exp(v - F.array_max("z"))), F.lit(0.0), lambda a, v: a + v)
    best = F.array_max(F.slice("z", 1, classes - 1))
    own = lambda c: 1 / (1 + F.exp(-F.get("alone", c)))
    top_class = (F.array_position("z", best) - 1).cast("int")
    like = F.transform(F.coalesce("like", F.array()), lambda t: F.struct(
        (F.size(t["has"]) / F.size(t["pairs"])).alias("part"), own(t["family"]).alias("own"), t["template"].alias("template"), t["family"].alias("family"),
        t["pairs"].alias("pairs"), t["has"].alias("has")))
    rows = rows.select("at", "doc_id", "line", like.alias("like"), top_class.alias("class"),
                       (F.exp(best - F.array_max("z")) / total).alias("among"), own(top_class).alias("own"))
    similarity = F.coalesce(F.array_max(F.transform(F.filter("like", lambda t: t["family"] == F.col("class")), lambda t: t["part"])), F.lit(0.0))
    sure = (F.col("among") >= model.least) & (similarity >= confirm)
    top = F.max(F.struct(sure.alias("sure"), "own", "class", similarity.alias("part"))).alias("top")
    # The piece where a template fits best speaks for it, so a paragraph has at most one entry a template.
    fits = [F.max(F.get(F.filter("like", _is_template(i)), F.lit(0))).alias(f"t{i}") for i in range(len(TEMPLATES))]
    with_fits = rows.groupBy("at", "doc_id", "line").agg(top, *fits)
    with_fits = with_fits.select("doc_id", "line", "top", F.array_compact(F.array(*[f"t{i}" for i in range(len(TEMPLATES))])).alias("fits"))

    def apart(t):
        def from_other(u):
            alone = F.size(F.array_except(t["pairs"], u["pairs"]))
            return (u["family"] == t["family"]) | ((alone > 0) & (F.size(F.array_except(t["has"], u["pairs"])) >= confirm * alone))

        return (t["own"] >= model.least_own) & F.forall("fits", from_other)

    found = F.transform(F.filter("fits", apart), lambda t: F.struct(t["family"].alias("family"), t["own"].alias("own"), t["part"].alias("part")))
    one = F.struct(F.when(F.col("top.sure"), F.col("top.class")).otherwise(len(FAMILIES)).alias("family"), F.col("top.own").alias("own"), F.col("top.part").alias("part"))
    named = with_fits.select("doc_id", "line", "top", found.alias("found")).select(
        "doc_id", "line", F.explode(F.when(F.size("found") > 0, _best_of_each(F.col("found"))).otherwise(F.array(one))).alias("f"))
    name = F.element_at(F.array(*[F.lit(f) for f in (*FAMILIES, "unknown")]), F.col("f.family") + 1)
    return named.select("doc_id", F.col("line").cast("int").alias("line"), name.alias("family"),
                        F.round("f.own", 6).alias("probability"), F.round("f.part", 6).alias("similarity"))


def _is_template(number: int):
    return lambda t: t["template"] == number


def _best_of_each(found):
    """One entry a family, that of the highest similarity, the first of equal ones."""
    better = lambda u, t: (u["family"] == t["family"]) & (u["part"] > t["part"])
    same = lambda t: F.array_position(F.transform(found, lambda u: F.struct(u["family"], u["part"])), F.struct(t["family"], t["part"]))
    return F.filter(found, lambda t, i: ~F.exists(found, lambda u: better(u, t)) & (same(t) == i + 1))
