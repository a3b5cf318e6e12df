"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document's failed filters are the bits of its mask, and documents are counted by part and mask
first: at most 2^k cells a part for k filters. Each cell then folds along every order (an
array of all k! orders that goes to the tasks with the plan) and gives one weighted struct a
step; the structs of a part's cells are added element by element. Documents are never
counted again for another order.

Equal texts: a document fails when a smaller id has its text. Rows are counted by (digest,
cell) before the smallest ids of the cells meet, so that a text which holds a third of all
rows is a few rows there. Ids meet their labels in one join that adaptive execution may split.

Defined results: a null text counts as empty and a null part as the empty string; no row gives
no part. Rows without an id are no copies and have no label. Rows that repeat the smallest id
of a text are no copies; a document's label counts if any of its label rows says so.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text) -> dict[str, Column]:
    """The four failure conditions that a text shows by itself."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and failed filters, those of good quality and toxic ones among them."""
    text = F.coalesce(docs["text"], F.lit(""))
    mask = sum((F.when(fails, 1 << FILTERS.index(k)).otherwise(0) for k, fails in text_failures(text).items()), F.lit(0))
    rows = docs.select(docs["doc_id"].alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(docs["lang"], F.lit("")).alias("part"), mask.alias("own"))
    known = (labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("id"))
             .agg(F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")))
    cell = ["part", "own", "good", "toxic"]
    named = (rows.filter("id is not null").join(known, "id", "left")
             .groupBy("id", "digest", "part", "own", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n")))
    of_text = named.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    first = of_text.groupBy("digest").agg(F.min("least.id").alias("first")).withColumnRenamed("digest", "same")
    met = of_text.join(first, F.col("digest") == F.col("same"))
    ahead = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))  # those of the smallest id
    copy = 1 << FILTERS.index("E")
    counted = met.select(*cell, F.explode(F.array(F.struct(F.lit(0).alias("bit"), ahead.alias("n")), F.struct(F.lit(copy).alias("bit"), (F.col("n") - ahead).alias("n")))).alias("c"))
    counted = counted.select("part", (F.col("own") + F.col("c.bit")).alias("mask"), "good", "toxic", F.col("c.n").alias("n"))
    nameless = rows.filter("id is null").groupBy("part", F.col("own").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    every = counted.unionByName(nameless.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n"))
    return every.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the ``cells`` of documents; bit i of ``mask`` says that the i-th filter fails.

    ``filters`` has one letter a filter, at most six (k! orders of k steps).
    """
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six different letters")
    orders = list(permutations(range(len(filters))))
    order_array = F.expr("array(" + ", ".join(f"array({', '.join(map(str, o))})" for o in orders) + ")")
    steps = F.expr("array(" + ", ".join(f"'{filters[k]}'" for o in orders for k in o) + ")")
    n, good, toxic, mask = (F.col(c) for c in ("n", "good", "toxic", "mask"))

    def along(order) -> Column:
        """The structs of one order: the state is whether the cell is still there and what has been written."""
        def step(state, k):
            bit = F.call_function("shiftleft", F.lit(1), k)
            fails = mask.bitwiseAND(bit) != 0
            here, there = state["left"] & fails, ~state["left"] & fails
            row = F.struct(*[F.when(cond, weight).otherwise(F.lit(0)).cast("bigint").alias(name) for name, cond, weight in zip(
                FIELDS, (state["left"] & ~fails, here, there, mask == bit, here, here), (n, n, n, n, good, toxic), strict=True)])
            return F.struct((state["left"] & ~fails).alias("left"), F.concat(state["out"], F.array(row)).alias("out"))

        nothing = F.expr("cast(array() as array<struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">>)")
        return F.aggregate(order, F.struct(F.lit(True).alias("left"), nothing.alias("out")), step, lambda s: s["out"])

    folded = counted.select("part", F.flatten(F.transform(order_array, along)).alias("steps"))

    def added(a, b):
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[f] + y[f]).alias(f) for f in FIELDS]))

    # A part has at most 2^k cells, whatever the number of documents.
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("all"))
    total = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.col("all")[0], added)
    merged = merged.select("part", total.alias("total"))
    share = F.transform(F.array(*map(F.lit, filters)), lambda f: F.struct(f.alias("filter"), F.aggregate(
        F.zip_with("total", steps, lambda t, s: F.when(s == f, t["removed"]).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("removed")))
    rows = merged.select("part", F.map_from_entries(share).alias("share"), F.posexplode("total").alias("at", "t"))
    names = F.expr("array(" + ", ".join(f"'{''.join(filters[k] for k in o)}'" for o in orders) + ")")
    size = len(filters)
    order, at = names[F.floor(F.col("at") / size).cast("int")], (F.col("at") % size + 1).cast("int")
    return rows.select("part", order.alias("filter_order"), at.alias("step"), *[F.col("t")[f].alias(f) for f in FIELDS],
                       F.col("share")[F.substring(order, at, F.lit(1))].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts of ``FIELDS`` and ``shapley`` for the five filters of ``docs``."""
    return interactions(cells(docs, labels))
