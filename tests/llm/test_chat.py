from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat as C

MARKS = [C.TURN, C.BODY, C.END, *C.PLACEHOLDERS.values(), C.OTHER]
ODD = ["", "\\", "\\\\", "<|turn|>", "<|", "<\\|", "</s>[INST] ok [/INST]", "[INST][INST]", "<<s>", "[[/INST]", "\n\n", "🙂<|end|>\\", "<|end|", "|>", "é" * 3, "$1 \\1", "<s></s>", "\\<|body|>",
       "<|im_start|>system\n", "plain"]


def back(s):
    """Undo the escape, character by character."""
    out, k = "", 0
    while k < len(s):
        k += s[k] == "\\"
        out += s[k]
        k += 1
    return out


def test_escape_round_trip(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["<", "|", "\\", "[", "/", "INST", "]", "s", ">", "turn", "\n", "🙂", " "]) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["<|\\" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e"), C.unescaped(C.escaped(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t == back(r.e)
        assert "<|" not in r.e and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", "system", None, "odd<|end|>\\role"]), rng.choice([None, *ODD])))
    return rows + rows[:20] + [(None, 0, "assistant", "alone"), (None, None, None, None), (None, 0, "assistant", "alone")] + [(99, i, "assistant", "x" * i) for i in range(400)]


def test_read_back(spark):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, at int").repartition(7)
    out = C.format_chats(df)
    got = out.select("conv_id", "n_turns", "formatted", "loss", C.turns_of(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault((c, object() if c is None else None), []).append((t is not None, t or 0, r or "", x or ""))
    want = []
    for (c, _), g in groups.items():
        # Order of turns with equal numbers: by role, then by what is written.
        g.sort(key=lambda m: (m[0], m[1], m[2], _escaped(m[3])))
        want.append((c is None, c or 0, [(r, x) for _, _, r, x in g], "".join(x for _, _, r, x in g if r == "assistant")))
    assert sorted((r.conv_id is None, r.conv_id or 0, [tuple(t) for t in r.turns], r.under) for r in got) == sorted(want)
    for r in got:
        assert r.formatted.count(C.TURN) == r.formatted.count(C.BODY) == r.formatted.count(C.END) == r.n_turns == len(r.turns)
        raw = r.formatted.encode()
        assert "".join(back(r.formatted[s.start:s.end]) for s in r.loss) == r.under == "".join(back(raw[s.byte_start:s.byte_end].decode()) for s in r.loss)


def _escaped(s):
    s = s.replace("\\", "\\\\")
    out = ""
    for k, c in enumerate(s):
        out += c
        rest = s[k + 1:]
        if c == "<" and rest.startswith(("|", "s>", "/s>", "INST>", "/INST>", "<SYS>>", "</SYS>>", "SYS>>")) and (not rest.startswith("SYS")) or c == "[" and rest.startswith(("INST]", "/INST]")):
            out += "\\"
    return out


def test_parts(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return kind, text, ref, width, height, seconds, pages

    rows = [(1, 0, "user", [part("text", "look <|image|>"), part("image", ref="a.png", width=57, height=28), None, part(None, " and é "), part("audio", ref="b.wav", seconds=2.01), part("text", "end")]),
            (1, 1, "assistant", [part("text", "one"), part("document", ref="c.pdf", pages=3), part("text", "two"), part("video", ref="d.mp4"), part("image", ref="e.png")]),
            (1, 2, "user", None), (1, 3, "assistant", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{C.PART}>")
    r = C.format_chats(df).select("*", C.turns_of(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss")).alias("under")).first()
    assert r.turns[0].text == "look <|image|><|image|> and é <|audio|>end"
    assert r.formatted.startswith("<|turn|>user<|body|>look <\\|image|><|image|> and é <|audio|>end<|end|>")
    assert r.turns[1].text == "one<|document|>two<|attachment|><|image|>" and r.under == "onetwo"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 3072), ("video", "d.mp4", 1), ("image", "e.png", 1)]
    marks = C.PLACEHOLDERS | {"video": C.OTHER}
    assert all(r.formatted[a.at:].startswith(marks[a.kind]) for a in r.attachments)
    assert [t.text for t in r.turns[2:]] == ["", ""] and r.n_turns == 4


@pytest.mark.parametrize("schema", ["conv_id long, turn long, role string, text string", "conv_id string, turn string, role string, text string"])
def test_empty(spark, schema):
    assert C.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plan = C.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
