"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is an array of parts: text, image, audio or document. A visitor flattens them into
one body in their order: text is escaped, every other part becomes a placeholder and is
recorded as an attachment with its reference, its place and the number of tokens that it
expands to. Bodies are framed by the template's marks and joined by turn. Spans of the loss
mask hold the text of the trained role and nothing else.

Control strings in texts and roles get a backslash behind their first character, and
backslashes are doubled first; so no mark of the template, and no other model's, can come
from a text, and ``unescaped`` gives the text back.

Defined results: a null text, role or part counts as empty text; a part without a kind is text;
an unknown kind is an attachment of one token; sizes that are missing count as one token.
Turns come by number (nulls first), then role, then body; repeated rows stay. A row without a
conversation id is a conversation of its own. A conversation is one value and has to fit one
(2 GB), however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Marks of the template, and the control strings to be escaped (with those of other templates).
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
CONTROL = r"(?:<(?=\||/?s>|/?INST>|<SYS>>|</SYS>>)|\[(?=/?INST\]))"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ref:string,tokens:bigint,at:bigint>"
SPAN = "struct<start:bigint,end:bigint,byte_start:bigint,byte_end:bigint>"


def escaped(text) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescaped(text) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def expanded_tokens(part) -> Column:
    """Tokens that an attachment takes in the model's input: image patches, audio frames, tokens of pages."""
    def up(x):
        return F.ceil(x).cast("bigint")

    count = (F.when(part["kind"] == "image", up(part["width"] / PATCH) * up(part["height"] / PATCH))
             .when(part["kind"] == "audio", up(part["seconds"] * AUDIO_RATE)).when(part["kind"] == "document", part["pages"].cast("bigint") * PAGE_TOKENS))
    return F.greatest(F.coalesce(count, F.lit(1).cast("bigint")), F.lit(1).cast("bigint"))


def visited(parts) -> Column:
    """``body``, ``attached`` and ``texts`` (spans of the texts in the body) of an array of parts."""
    zero = F.lit(0).cast("bigint")

    def piece(part):
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        mark = F.lit(OTHER)
        for kind, name in PLACEHOLDERS.items():
            mark = F.when(part["kind"] == kind, name).otherwise(mark)
        return F.struct(is_text.alias("is_text"), F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(mark).alias("out"),
                        part["kind"].alias("kind"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens"))

    def visit(state, p):
        long, wide = F.length(p["out"]).cast("bigint"), F.octet_length(p["out"]).cast("bigint")
        span = F.struct(state["at"].alias("start"), (state["at"] + long).alias("end"), state["byte"].alias("byte_start"), (state["byte"] + wide).alias("byte_end"))
        other = F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), state["at"].alias("at"))
        return F.struct((state["at"] + long).alias("at"), (state["byte"] + wide).alias("byte"),
                        F.when(p["is_text"], F.concat(state["texts"], F.array(span))).otherwise(state["texts"]).alias("texts"),
                        F.when(p["is_text"], state["attached"]).otherwise(F.concat(state["attached"], F.array(other))).alias("attached"))

    pieces = F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), piece)
    start = F.struct(zero.alias("at"), zero.alias("byte"), F.array().cast(f"array<{SPAN}>").alias("texts"), F.array().cast(f"array<{ATTACHMENT}>").alias("attached"))
    # The pieces are bound once; the fold and the joined body both read them.
    return F.transform(F.array(pieces), lambda ps: F.aggregate(ps, start, visit, lambda s: F.struct(
        F.array_join(F.transform(ps, lambda p: p["out"]), "").alias("body"), s["attached"].alias("attached"), s["texts"].alias("texts"))))[0]


def format_chats(turns: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, formatted, loss, attachments`` of the rows ``conv_id, turn, role, text``, or ``parts`` instead of ``text``.

    ``loss`` holds spans of ``formatted`` (characters and UTF-8 bytes, ends exclusive) with the
    texts of the role ``trained``; ``attachments`` has kind, reference, expanded tokens and the
    placeholder's place in ``formatted``, in their order there. ``parts`` is an array of ``PART``.
    """
    content = turns["parts"].cast(f"array<{PART}>") if "parts" in turns.columns else text_parts(turns["text"])
    role = F.coalesce(turns["role"], F.lit(""))
    rows = turns.select(turns["conv_id"].alias("conv"), turns["turn"].alias("turn"), role.alias("role"), visited(content).alias("v"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    rows = rows.select("conv", "turn", "role", "v", head.alias("head"))
    segment = F.concat("head", "v.body", F.lit(END))
    rows = rows.select("conv", "turn", "role", F.col("v.attached").alias("attached"), segment.alias("segment"),
                       F.when(F.col("role") == trained, F.col("v.texts")).otherwise(F.array().cast(f"array<{SPAN}>")).alias("texts"),
                       F.length("head").cast("bigint").alias("skip"), F.octet_length("head").cast("bigint").alias("byte_skip"))

    together = Window.partitionBy("conv").orderBy("turn", "role", "segment", "attached").rowsBetween(Window.unboundedPreceding, -1)

    def before(size):
        return F.coalesce(F.sum(size("segment").cast("bigint")).over(together), F.lit(0).cast("bigint"))

    def placed(df, at, byte) -> DataFrame:
        """One struct a turn, its spans and places counted from the start of the conversation."""
        df = df.withColumns({"at": at, "byte": byte})
        here, bytes_here = F.col("at") + F.col("skip"), F.col("byte") + F.col("byte_skip")
        spans = F.transform("texts", lambda s: F.struct((s["start"] + here).alias("start"), (s["end"] + here).alias("end"),
                                                        (s["byte_start"] + bytes_here).alias("byte_start"), (s["byte_end"] + bytes_here).alias("byte_end")))
        marks = F.transform("attached", lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), (a["at"] + here).alias("at")))
        return df.select("conv", F.struct("at", "segment", spans.alias("loss"), marks.alias("attached")).alias("t"))

    def joined(segments) -> list[Column]:
        return [F.size(segments).cast("bigint").alias("n_turns"), F.array_join(F.transform(segments, lambda t: t["segment"]), "").alias("formatted"),
                F.flatten(F.transform(segments, lambda t: t["loss"])).alias("loss"), F.flatten(F.transform(segments, lambda t: t["attached"])).alias("attachments")]

    zero = F.lit(0).cast("bigint")
    whole = placed(rows.filter("conv is not null"), before(F.length), before(F.octet_length)).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    alone = placed(rows.filter("conv is null"), zero, zero).select("conv", F.array("t").alias("ts"))
    return whole.unionByName(alone).select(F.col("conv").alias("conv_id"), *joined(F.col("ts")))


def turns_of(formatted) -> Column:
    """Read back: an array of (role, text); placeholders stand in the text where they stood."""
    def turn(segment):
        return F.struct(unescaped(F.substring_index(segment, BODY, 1)).alias("role"),
                        unescaped(F.regexp_replace(F.substring(segment, F.instr(segment, BODY) + len(BODY), F.length(segment)), r"\Q" + END + r"\E$", "")).alias("text"))

    return F.transform(F.slice(F.split(formatted, r"\Q" + TURN + r"\E"), F.lit(2), F.size(F.split(formatted, r"\Q" + TURN + r"\E"))), turn)


def loss_text(formatted, loss) -> Column:
    """Read back: all text under the mask, unescaped, with nothing between."""
    return F.transform(F.array(formatted.cast("binary")), lambda raw: F.array_join(F.transform(loss, lambda s: unescaped(
        F.substring(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string"))), ""))[0]
