"""Tokenising, word counts and keywords."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.core.session import stable
from tablewright.core.types import quoted

SEPARATOR = "、"

# Single characters dropped after segmentation.
STOP_CHARACTERS = (
    ":!),.:;?]}¢'\"、。〉》」』】〕〗〞︰︱︳﹐､﹒\n ﹔﹕﹖﹗﹚﹜﹞！），．：；？｜｝︴︶︸︺︼︾﹀﹂﹄﹏､～￠"
    "々‖•·ˇˉ―--′’”([{£¥'\"‵〈《「『【〔〖（［｛￡￥〝︵︷︹︻︽︿﹁﹃﹙﹛﹝（｛“‘-—_…"
)

# English words that are never keywords.
STOP_WORDS = (
    "the of is and to in that we for an are by be as on with can if from which you it this "
    "then at have all not one has or that"
).split()

# Latin letters and digits, with a decimal part and a percent sign; otherwise one character.
_WORD = r"[a-zA-Z0-9]+(?:\.[0-9]+)?%?"
# Stop characters match no branch, so they never become tokens.
TOKEN = _WORD + "|[^a-zA-Z0-9" + "".join("\\" + c if c in r"[]^-\&" else c for c in sorted(set(STOP_CHARACTERS))) + "]"
_HAN = regex.compile(r"([一-鿕]+)")


def tokens(col: Column, dictionary: Mapping[str, float] | None = None) -> Column:
    """Tokens of a text as an array, stop characters left out; null for empty text.

    Without a dictionary every Chinese character is a token. With one (word ->
    frequency) runs of Chinese characters are cut along the most probable path.
    """
    text = F.when(F.length(col) > 0, col)
    if dictionary is None:
        return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)
    return _dictionary_udf(dict(dictionary))(text)


def cut_run(run: str, logp: Mapping[str, float], longest: int) -> list[str]:
    """Most probable segmentation of a run of Chinese characters."""
    n, floor = len(run), min(logp.values(), default=0.0)
    best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = []
        for j in range(i + 1, min(n, i + longest) + 1):
            w = run[i:j]
            if w in logp or j == i + 1:
                options.append((logp.get(w, floor) + best[j][0], j))
        best[i] = max(options)
    out, i = [], 0
    while i < n:
        out.append(run[i:best[i][1]])
        i = best[i][1]
    return out


def _dictionary_udf(dictionary: Mapping[str, float]):
    total = math.log(sum(dictionary.values()) or 1.0)
    logp = {w: math.log(f or 1.0) - total for w, f in dictionary.items()}
    longest = max(map(len, logp), default=1)
    token = regex.compile(TOKEN, regex.DOTALL)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out = []
            for part in _HAN.split(text):
                out.extend(cut_run(part, logp, longest) if _HAN.fullmatch(part) else token.findall(part))
            return out

        return texts.map(one)

    return cut


def _spread(df: DataFrame) -> int:
    """As many parts as a shuffle has, fixed, so that adaptive execution does not join them again for their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


PART_CHARACTERS = 4_000_000  # of the texts whose words one task counts


def _parts(df: DataFrame, col: str) -> int:
    """A number of parts that grows with the texts, so that the words of one part do not; never fewer than a shuffle has."""
    characters = df.agg(F.sum(F.length(quoted(col).cast("string")))).first()[0] or 0
    return max(_spread(df), -(-characters // PART_CHARACTERS))


def cut_word(df: DataFrame, col: str, dictionary: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``seg_result``: the tokens joined by an ideographic comma.

    Rows are dealt out evenly first: cutting takes far longer than moving a text, and a file
    of one row group, or one with all long texts, would otherwise be cut in one task.
    """
    return df.repartition(_spread(df)).withColumn("seg_result", F.array_join(tokens(quoted(col).cast("string"), dictionary), SEPARATOR))


def token_counts(df: DataFrame, id: str, col: str, dictionary: Mapping[str, float] | None = None, parts: int | None = None) -> DataFrame:
    """(id, word, n) per document."""
    # Dealt by id once: cutting is spread evenly, and the counts need no further shuffle.
    words = df.select(quoted(id), quoted(col)).repartition(parts or _parts(df, col), quoted(id)).select(quoted(id), F.explode(tokens(quoted(col).cast("string"), dictionary)).alias("word"))
    return words.groupBy(id, "word").agg(F.count(F.lit(1)).alias("n"))


def word_count(df: DataFrame, id: str, col: str, dictionary: Mapping[str, float] | None = None) -> DataFrame:
    """Every document row followed by one child row per distinct word.

    ``node_id`` / ``parent_id`` link them; a child's other columns are empty.
    """
    parent_key = quoted(id).cast("string")
    parents = df.select(parent_key.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "*",
                        F.lit(None).cast("string").alias("tag_result"),
                        F.lit(None).cast("long").alias("word_count"))
    children = token_counts(df, id, col, dictionary).select(
        F.concat(parent_key, F.lit("/"), F.col("word")).alias("node_id"), parent_key.alias("parent_id"),
        F.col("word").alias("tag_result"), F.col("n").alias("word_count"))
    return parents.unionByName(children, allowMissingColumns=True)


def _is_keyword(word: Column) -> Column:
    return (F.length(F.trim(word)) >= 2) & ~F.lower(word).isin(*STOP_WORDS)


def word_tag(df: DataFrame, id: str, col: str, top_k: int = 20,
             dictionary: Mapping[str, float] | None = None, idf: DataFrame | None = None) -> DataFrame:
    """Add ``tag_result``: the top_k words of each document by TF-IDF; ``id`` names rows uniquely.

    Words have at least two characters and are not stop words. ``idf`` is a
    (word, idf) table, unknown words get its median; without it the inverse
    document frequencies come from the table itself.
    """
    parts = _parts(df, col)
    counts = token_counts(df, id, col, dictionary, parts).where(_is_keyword(F.col("word")))
    if idf is None:
        # Used twice, and much smaller than the texts: cut them once.
        counts = stable(counts)
        n_docs = df.count()
        idf = counts.groupBy("word").agg(F.count(F.lit(1)).alias("_df")).select(
            "word", F.ln(F.lit(float(n_docs)) / F.col("_df")).alias("idf"))
        middle = 0.0
    else:
        middle = idf.agg(F.percentile_approx("idf", 0.5)).first()[0]
    # Dealt into as many parts as the texts ask for, by word and then by document, so that what a task sorts
    # does not grow; a word has one row a document at most.
    weighted = counts.repartition(parts, "word").join(idf.select("word", "idf"), "word", "left")
    # Dividing by the length of the document would not change the order of its words.
    weight = F.round(F.col("n") * F.coalesce("idf", F.lit(middle)), 9)
    w = Window.partitionBy(id).orderBy(F.col("_w").desc(), "word")
    top = weighted.withColumn("_w", weight).repartition(parts, quoted(id)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k)
    ordered = F.array_sort(F.collect_list(F.struct("_r", "word")))  # top_k entries
    tags = top.groupBy(F.col(id).alias("_tag_id")).agg(
        F.array_join(F.transform(ordered, lambda s: s["word"]), SEPARATOR).alias("_tags"))
    # The text itself takes no part in the join unless the caller keeps it.
    marked = df.withColumn("_has_text", F.length(quoted(col).cast("string")) > 0)
    value = F.when(F.col("_has_text"), F.coalesce(F.col("_tags"), F.lit("")))
    joined = marked.join(tags, quoted(id) == F.col("_tag_id"), "left").withColumn("tag_result", value)
    return joined.drop("_tag_id", "_tags", "_has_text")
