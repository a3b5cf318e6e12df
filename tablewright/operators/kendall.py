"""Kendall tau-b correlation without enumerating pairs of rows.

Only the number of discordant pairs is hard. The distinct values of each column,
with the rows up to each, are cut into blocks of about equal rows; a value shared by
more rows than that is a block of its own, so it never lands in a block that has to
be counted row by row. Discordant pairs then fall into three disjoint kinds:

* same block of ``a``: counted inside that block;
* other block of ``a``, same block of ``b``: counted inside the ``b`` block with
  ``a`` replaced by its block number;
* other block of both: counted on the block-by-block table, one binary digit of
  the ``b`` block at a time, with running sums.

Every unit of work is bounded by the block size or by the number of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.core.layout import running_sum
from tablewright.core.session import hold, stable
from tablewright.core.types import quoted, require_numeric

BLOCK_ROWS = 500_000


def discordant(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Weighted pairs with a_i < a_j and b_i > b_j, one binary digit of b's rank at a time."""
    _, rank = np.unique(b, return_inverse=True)
    order = np.lexsort((rank, a))
    a, rank, w = a[order], rank[order], w[order].astype(float)
    bits = int(rank.max()).bit_length() if len(rank) else 0
    total = 0.0
    for bit in range(bits - 1, -1, -1):
        group = rank >> (bit + 1)
        at = np.argsort(group, kind="stable")  # keeps the order of a inside a group
        g, aa, ww = group[at], a[at], w[at]
        high = ((rank[at] >> bit) & 1).astype(bool)
        before = np.cumsum(np.where(high, ww, 0.0))
        before = np.concatenate(([0.0], before))
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_value = new_group | np.concatenate(([True], aa[1:] != aa[:-1]))
        index = np.arange(len(g))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        value_start = np.maximum.accumulate(np.where(new_value, index, 0))
        smaller_a = before[value_start] - before[group_start]
        total += float((smaller_a * np.where(high, 0.0, ww)).sum())
    return total


def _blocks(values: DataFrame, columns: Sequence[str], block_rows: int) -> DataFrame:
    """(kind, v, block) of each distinct value of each column; blocks rise with the value.

    An even number is an interval of less than two blocks' rows, an odd one a single value.
    """
    cells = values.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), (quoted(c) + 0.0).alias("v")) for k, c in enumerate(columns)])))
    counts = cells.where("v is not null and not isnan(v)").groupBy("kind", "v").agg(F.count(F.lit(1)).alias("rows"))
    upto = running_sum(counts, {"upto": "rows"}, "v", by="kind")
    alone = F.when(F.col("rows") >= block_rows, 1).otherwise(0)
    return upto.select("kind", "v", (2 * F.floor((F.col("upto") - F.col("rows")) / block_rows) + alone).alias("block"))


def _inside(cells: DataFrame, block: str, a: str) -> DataFrame:
    """Discordant pairs counted inside each block of at most about BLOCK_ROWS rows."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = discordant(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"pair": [key[0]], "d": [d]})

    rows = cells.where(F.col(block) % 2 == 0).select("pair", block, F.col(a).alias("a"), "b", "w")
    return rows.groupBy("pair", block).applyInPandas(count, "pair int, d double")


def _across(cells: DataFrame, digits: int) -> DataFrame:
    """Discordant pairs between different blocks of both columns."""
    grid = cells.groupBy("pair", "block_a", "block_b").agg(F.sum("w").alias("w"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(digits - 1, 0)))).alias("level")
    steps = grid.select("pair", "block_a", "block_b", "w", levels).select(
        "pair", "level", "block_a",
        F.expr("shiftright(block_b, level + 1)").alias("group"),
        (F.expr("shiftright(block_b, level)") % 2).alias("digit"),
        "w",
    )
    high = F.sum(F.when(F.col("digit") == 1, F.col("w")).otherwise(0.0)).alias("high")
    low = F.sum(F.when(F.col("digit") == 0, F.col("w")).otherwise(0.0)).alias("low")
    summed = steps.groupBy("pair", "level", "group", "block_a").agg(high, low)
    # One row per block of a at most, so this window is bounded by the block count.
    w = (Window.partitionBy("pair", "level", "group").orderBy("block_a")
         .rowsBetween(Window.unboundedPreceding, -1))
    d = F.coalesce(F.sum("high").over(w), F.lit(0.0)) * F.col("low")
    return summed.select("pair", d.alias("d"))


def _term(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return rows.select("pair", F.lit(name).alias("term"), value.alias("v"))


def _tied(cells: DataFrame, key: str, name: str) -> DataFrame:
    t = cells.groupBy("pair", key).agg(F.sum("w").alias("t"))
    return _term(t, name, F.col("t") * (F.col("t") - 1) / 2)


def kendall_pairs(df: DataFrame, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """tau-b of every pair of columns, as (a, b, tau); pairs with a constant column are null.

    Rows where either value is missing do not count for that pair.
    """
    columns = list(columns)
    require_numeric(df, columns)
    values = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    blocks = stable(_blocks(values, columns, block_rows))
    pairs = list(combinations(range(len(columns)), 2))
    wide = F.explode(F.array(*[
        F.struct(F.lit(k).alias("pair"), quoted(columns[i]).alias("a"), quoted(columns[j]).alias("b"))
        for k, (i, j) in enumerate(pairs)
    ]))
    kept = (values.select(wide.alias("s")).select("s.*")
            .where("a is not null and b is not null and not isnan(a) and not isnan(b)"))
    # -0.0 and 0.0 group together after adding 0.0
    cells = kept.groupBy("pair", (F.col("a") + 0.0).alias("a"), (F.col("b") + 0.0).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("w"))
    side_a = F.element_at(F.lit([i for i, _ in pairs]), F.col("pair") + 1)
    side_b = F.element_at(F.lit([j for _, j in pairs]), F.col("pair") + 1)
    for name, side in (("a", side_a), ("b", side_b)):
        of = blocks.select(F.col("kind").alias("_kind"), F.col("v").alias("_v"), F.col("block").alias(f"block_{name}"))
        cells = cells.join(of, (side == F.col("_kind")) & (F.col(name) == F.col("_v"))).drop("_kind", "_v")
    cells = hold(cells)
    most = 1 + (blocks.agg(F.max("block")).first()[0] or 0)
    by_b = cells.groupBy("pair", "block_a", "block_b", "b").agg(F.sum("w").alias("w"))
    parts = [_term(_inside(cells, "block_a", "a"), "d", F.col("d"))]
    if most > 1:
        parts.append(_term(_inside(by_b, "block_b", "block_a"), "d", F.col("d")))
        parts.append(_term(_across(cells, (most - 1).bit_length()), "d", F.col("d")))
    parts += [_term(cells, "n", F.col("w")), _term(cells, "n3", F.col("w") * (F.col("w") - 1) / 2)]
    parts += [_tied(cells, "a", "n1"), _tied(cells, "b", "n2")]
    terms = reduce(DataFrame.unionByName, parts).groupBy("pair").agg(
        *[F.coalesce(F.sum(F.when(F.col("term") == k, F.col("v"))), F.lit(0.0)).alias(k)
          for k in ("d", "n", "n1", "n2", "n3")])
    n0 = F.col("n") * (F.col("n") - 1) / 2
    c = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    below = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    rows = terms.select("pair", F.try_divide(c - F.col("d"), below).alias("tau")).collect()
    cells.unpersist()
    tau = {r["pair"]: r["tau"] for r in rows}  # one row per pair of columns
    out = [(columns[i], columns[j], tau.get(k)) for k, (i, j) in enumerate(pairs)]
    return df.sparkSession.createDataFrame(out, "a string, b string, tau double")


def kendall_matrix(df: DataFrame, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Symmetric tau-b matrix; undefined correlations are 0."""
    columns = list(columns)
    out = np.eye(len(columns))
    if len(columns) > 1:
        for a, b, tau in kendall_pairs(df, columns, block_rows).collect():
            i, j = columns.index(a), columns.index(b)
            out[i, j] = out[j, i] = 0.0 if tau is None else tau
    return out
