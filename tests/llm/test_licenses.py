from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from tablewright.llm import licenses as L

FILL = "thnt ereanes onble wh thing or edtion anre heon stour"


@pytest.fixture(scope="module")
def model():
    return L.fit([FILL + f" w{i}" for i in range(300)])


def test_families_and_unknown(spark, model):
    rows = [(k, FILL + "\n" + t.capitalize() + ".\n" + FILL) for k, (_, t) in enumerate(L.TEMPLATES)]
    rows += [(100, "Licensed under the Frobnicate License, Version 9.0."), (101, "no anchor here"), (102, None), (103, ""), (104, "warrants that he " + FILL),
             (105, "LICENSED%%% UNDER&&& THE### APACHE*** LICENSE,$$$ VERSION 2.0."), (106, (FILL + " ") * 20_000 + "Released under the MIT License."),
             (107, "Released under the MIT License."), (107, "Released under the MIT License."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, family string").repartition(3)
    got = L.scan(df, model).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.family)
    right = sum(found.get(k) == [f] for k, (f, t) in enumerate(L.TEMPLATES) if k in found)
    assert right >= 0.9 * sum(k in found for k in range(len(L.TEMPLATES)))
    assert found[100] == ["unknown"] and found[104] == ["unknown"] and not {101, 102, 103} & set(found)
    assert found[105] == ["apache-2.0"] and found[106] == ["mit"] and found[107] == ["mit", "mit"] and found[None] == ["mit"]


def test_made_statements_kept_out(model):
    import random

    rng = random.Random(99)
    filler = [f"q{i}" for i in range(200)]
    right = wrong = unknown = 0
    for _ in range(400):
        words, c = L._made(rng, filler)
        z = model.bias.copy()
        for g in L.ngrams(words):
            if g in model.features:
                z = z + model.weights[model.features[g]]
        p = L._softmax(z[None])[0]
        k = int(p[:-1].argmax())
        if c == len(L.FAMILIES):
            unknown += 1
            wrong += p[k] >= model.least
        else:
            right += k == c and p[k] >= model.least
    assert right >= 0.8 * (400 - unknown) and wrong <= 0.05 * unknown


def test_train_and_empty(spark):
    docs = spark.createDataFrame([(i, FILL) for i in range(20)] + [(50, None)], "doc_id long, text string")
    small = L.train(docs, statements=200, steps=20)
    assert L.scan(docs.limit(0), small).count() == 0 and L.scan(docs, small).count() == 0
    assert L.train(docs.limit(0), statements=200, steps=20).features


def test_wrapped_statements_and_several_families(spark, model):
    import textwrap

    long = [(k, f, t) for k, (f, t) in enumerate(L.TEMPLATES) if len(t.split()) >= 12]
    rows = [(k, "x = 1\n\n" + "\n".join("# " + x for x in textwrap.wrap(t.capitalize() + ".", 50)) + "\n#\n# " + FILL) for k, _, t in long]
    both = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    rows += [(200, both), (201, both.replace(". ", ".\n")), (202, "Licensed under CC BY\nSA 4.0"), (203, (FILL + "\n") * 300 + "Redistribution and use in source and binary forms,\n"
             "with or without modification, are permitted provided\nthat the following conditions are met:\n" + (FILL + "\n") * 300), (204, "to the public\ndomain of " + FILL)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    found, lines = {}, {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.family)
        lines.setdefault(r.doc_id, []).append(r.line)
    assert {k: found.get(k) for k, _, _ in long} == {k: [f] for k, f, _ in long}
    assert all(lines[k] == [2] for k, _, _ in long)
    assert sorted(found[200]) == sorted(found[201]) == ["apache-2.0", "mit"]
    assert found[202] == ["cc-by-sa"] and found[203] == ["bsd"] and found[204] == ["unknown"]


OTHERS = """AAL ADSL AFL-2.1 AMDPLPA ANTLR-PD APAFML APL-1.0 APSL-2.0 Abstyles Adobe-2006 Afmparse Aladdin Artistic-1.0 BitTorrent-1.1 Borceux BSD-4-Clause BSD-Protection BSD-Source-Code
CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-SA-2.0 CC-PDDC CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CECILL-B CECILL-C ClArtistic CNRI-Jython Condor-1.1 CPAL-1.0 CPL-1.0 CPOL-1.02
Crossword CUA-OPL-1.0 Cube curl D-FSL-1.0 diffmark DOC Dotseqn DSDP ECL-2.0 EFL-2.0 eGenix Entessa EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.1 Eurosym Fair Frameworx-1.0 FreeImage FSFAP FTL GFDL-1.3-only
Giftware GL2PS Glide Glulxe gnuplot gSOAP-1.3b HaskellReport HPND IBM-pibs ICU IJG ImageMagick iMatix Imlib2 Info-ZIP Intel Interbase-1.0 IPA IPL-1.0 JasPer-2.0 JSON Latex2e Leptonica Libpng libtiff
LiLiQ-P-1.1 LPL-1.02 LPPL-1.3c MakeIndex MirOS MITNFA Motosoto mpich2 MPL-1.0 MS-RL MTLL Multics Mup NASA-1.3 Naumen NBPL-1.0 Net-SNMP NetCDF Newsletr NGPL NLOD-1.0 NLPL Nokia NOSL Noweb NPL-1.1
NPOSL-3.0 NRL NTP OCLC-2.0 ODbL-1.0 OGTSL OLDAP-2.8 OML Opus OSET-PL-2.1 Parity-6.0.0 PDDL-1.0 PHP-3.01 Plexus psfrag Python-2.0 QPL-1.0 Ruby Sleepycat SPL-1.0 TCL Vim W3C Xnet ZPL-2.1""".split()


def named(spark, model, texts):
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), model).collect()
    return [sorted(r.family for r in got if r.doc_id == k) for k in range(len(texts))]


def test_every_template_is_set_apart():
    assert all(L._EXCLUSIVE) and len(L.TEMPLATES) > 55


def test_other_licences_are_no_family(spark, model):
    texts = [f"# SPDX-License-Identifier: {x}\n" for x in OTHERS] + ["Zope Public License version 2.1", "Licensed under the Eclipse Public License version 2.0", "Released under the Ruby License",
             "This work is licensed under the Open Data Commons license", "Copyright 2019 by the authors", "You need permission to use the hall"]
    got = named(spark, model, texts)
    assert [f for f in got if f != ["unknown"]] == []


def test_identifiers_and_notices(spark, model):
    wanted = [(f, f"// SPDX-License-Identifier: {x}") for f, ids in L.IDENTIFIERS.items() for x in ids.split()]
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    wanted += [("agpl", notice.format("Affero ")), ("gpl", notice.format("")), ("lgpl", notice.format("Lesser ").replace("program", "library")), ("mit", "distributed under the terms of the MIT licence."),
               ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
               ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.")]
    assert named(spark, model, [t for _, t in wanted]) == [[f] for f, _ in wanted]


def test_long_paragraphs_take_time_in_proportion(spark, model):
    took = []
    for n in (500, 8_000, 16_000):
        df = spark.createDataFrame([(1, "\n".join(f"license line {i} of the text" for i in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        L.scan(df, model).collect()
        took.append(time.perf_counter() - start)
    assert took[2] <= 2.5 * took[1] + 2


def plain_scan(model, text):
    """Families of one paragraph, piece by piece."""
    lines = [" ".join(re.sub("[^a-z0-9]+", " ", re.sub(r"spdx-license-identifier: *([a-z0-9.+-]+)", r"spdx license identifier \1 spdxend ", x.lower().replace("licence", "license"))).split())
             for x in text.split("\n")]
    words = " ".join(lines).split()
    pieces = [" ".join(words[i:i + 64]) for i in range(0, max(1, len(words) - 32), 32)]
    pieces = [p for p in dict.fromkeys(pieces + lines) if re.search(L.ANCHOR, p)]
    fits, sure = {}, []
    own_weights = model.own()
    for p in pieces:
        grams = L.ngrams(p.split())
        rows = [model.features[g] for g in grams if g in model.features]
        z = model.bias + model.weights[rows].sum(axis=0)
        own = 1 / (1 + np.exp(-(own_weights[rows].sum(axis=0) + model.bias[:-1] - model.bias[-1])))
        among = L._softmax(z[None])[0][:-1]
        likes = {}
        for k, (f, t) in enumerate(L.TEMPLATES):
            pairs = L.ngrams(t.split(), (2,))
            if len(pairs & grams) >= 0.6 * len(pairs) and len(L._EXCLUSIVE[k] & grams) >= 0.6 * len(L._EXCLUSIVE[k]):
                likes[k] = (len(pairs & grams) / len(pairs), own[L.FAMILIES.index(f)], pairs & grams)
        for k, v in likes.items():
            if k not in fits or v[:2] > fits[k][:2]:
                fits[k] = v
        top = int(among.argmax())
        sure.append((among[top] >= model.least and any(L.TEMPLATES[k][0] == L.FAMILIES[top] for k in likes), L.FAMILIES[top]))
    found = set()
    for k, (_, own, has) in fits.items():
        f, t = L.TEMPLATES[k]
        pairs = L.ngrams(t.split(), (2,))
        others = [L.ngrams(L.TEMPLATES[u][1].split(), (2,)) for u in fits if L.TEMPLATES[u][0] != f]
        if own >= model.least_own and all(pairs - o and len(has - o) >= 0.6 * len(pairs - o) for o in others):
            found.add(f)
    return sorted(found) or sorted({f for ok, f in sure if ok}) or ["unknown"]


def test_against_plain_version(spark, model):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        words, _ = L._made(rng, FILL.split())
        texts.append(" ".join(words) + rng.choice(["", " copyright", "\nlicense\n" + FILL]))
    texts = [t for t in texts if re.search(L.ANCHOR, t)]
    got = named(spark, model, texts)
    assert len(texts) > 40 and all(g == w or len(w) > 1 for g, w in zip(got, (plain_scan(model, t) for t in texts), strict=True))
