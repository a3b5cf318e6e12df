"""Data behind charts: the chosen columns as rows, or the aggregate a big table needs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.core.layout import as_names
from tablewright.core.session import discard, stable
from tablewright.core.types import known, quoted, require_columns, require_numeric
from tablewright.operators.prep import hash_unit

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
BINS = 1 << 16  # bins that a range of values is counted in


def _rows(df: DataFrame, columns: Sequence[str], mode: str) -> bool:
    require_columns(df, columns)
    if mode not in ("rows", "aggregate"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode == "rows"


def chart_scatter(df: DataFrame, x: str, y: str, mode: str = "rows", bins: int = 50) -> DataFrame:
    """Points, or how many of them fall in each cell of a ``bins`` by ``bins`` grid.

    Cells come with their edges; points without a number on either side are left out.
    """
    if _rows(df, [x, y], mode):
        return df.select(quoted(x), quoted(y))
    require_numeric(df, [x, y])
    ends = df.where(known(x).isNotNull() & known(y).isNotNull()).agg(
        *[f(quoted(c)).cast("double") for c in (x, y) for f in (F.min, F.max)]).first()
    at, edges = {}, {}
    for c, name, lo, hi in ((x, "x", *ends[:2]), (y, "y", *ends[2:])):
        lo, width = lo or 0.0, ((hi or 0.0) - (lo or 0.0)) / bins or 1.0
        cell = F.floor((known(c).cast("double") - F.lit(lo)) / F.lit(width))
        at[name] = F.when(cell < bins, cell).when(cell.isNotNull(), bins - 1).cast("int")
        edges |= {f"{name}_low": F.lit(lo) + F.col(f"_{name}") * width, f"{name}_high": F.lit(lo) + (F.col(f"_{name}") + 1) * width}
    cells = df.select(at["x"].alias("_x"), at["y"].alias("_y")).where("_x is not null and _y is not null")
    counts = cells.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*[v.alias(k) for k, v in edges.items()], "n")


def sample_share(df: DataFrame, key, share: float, seed: int = 0) -> DataFrame:
    """The rows whose key hashes into the given share."""
    return df.where(hash_unit(key, seed, 10_000) < int(round(share * 10_000)))


def chart_line(df: DataFrame, x: str, y: str, mode: str = "rows") -> DataFrame:
    """Points, or the mean of y per x."""
    if _rows(df, [x, y], mode):
        return df.select(quoted(x), quoted(y))
    return df.groupBy(x).agg(F.avg(quoted(y)).alias(y)).orderBy(x)


def chart_histogram(df: DataFrame, x: str, y: str | None = None, mode: str = "rows",
                    bins: int | None = None) -> DataFrame:
    """Points, the sum of y per x, or (with ``bins``) counts in equal bins of x."""
    columns = [x] + ([y] if y else [])
    if _rows(df, columns, mode):
        return df.select(*[quoted(c) for c in columns])
    if bins is None:
        return df.groupBy(x).agg(F.sum(quoted(y)).alias(y))
    require_numeric(df, [x])
    lo, hi = df.agg(F.min(quoted(x)).cast("double"), F.max(quoted(x)).cast("double")).first()
    width = (hi - lo) / bins or 1.0
    v = quoted(x).cast("double")
    at = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    out = df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({"low": F.lit(lo) + F.col("bin") * width, "high": F.lit(lo) + (F.col("bin") + 1) * width})


def chart_pie(df: DataFrame, dimension: str, value: str, mode: str = "rows") -> DataFrame:
    """Rows, or each slice's sum and share of the total."""
    if _rows(df, [dimension, value], mode):
        return df.select(quoted(dimension), quoted(value))
    total = df.agg(F.sum(quoted(value)).alias("_total"))  # one row; grouped and total sums share the scan
    slices = df.groupBy(dimension).agg(F.sum(quoted(value)).alias(value))
    return slices.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(quoted(value), F.col("_total"))).drop("_total")


def chart_spider(df: DataFrame, dimensions: Sequence[str], mode: str = "rows") -> DataFrame:
    """Rows, or (dimension, value) with the mean of each dimension."""
    if _rows(df, dimensions, mode):
        return df.select(*[quoted(c) for c in dimensions])
    require_numeric(df, dimensions)
    one = df.agg(*[F.avg(quoted(c)).alias(f"_{i}") for i, c in enumerate(dimensions)])
    cells = [F.struct(F.lit(c).alias("dimension"), F.col(f"_{i}").alias("value")) for i, c in enumerate(dimensions)]
    return one.select(F.inline(F.array(*cells)))


def chart_bubble(df: DataFrame, x: str, y: str, mode: str = "rows") -> DataFrame:
    """Points, or distinct points with their number as size."""
    if _rows(df, [x, y], mode):
        return df.select(quoted(x), quoted(y))
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("size"))


def chart_tree(df: DataFrame, id: str, pid: str, name: str, value: str, mode: str = "rows") -> DataFrame:
    """Nodes, or nodes with the total value of their subtree; ``id`` names nodes, and a cycle is an error.

    Pointers double: after k steps a node knows the sum of everything less than 2^k levels
    below it and its ancestor 2^k levels up, so a tree of any depth takes the logarithm of it.
    """
    if _rows(df, [id, pid, name, value], mode):
        return df.select(*[quoted(c) for c in (id, pid, name, value)])
    state = stable(df.where(quoted(id).isNotNull()).groupBy(quoted(id).alias("_node")).agg(
        F.max(quoted(pid)).alias("_up"), F.sum(quoted(value).cast("double")).alias("_sum")))
    steps = max(1, state.count()).bit_length() + 1  # no path is longer than the number of nodes
    while not (live := state.where("_up is not null")).isEmpty():
        if not steps:
            raise ValueError(f"{id} and {pid} form a cycle")
        steps -= 1
        below = live.groupBy(F.col("_up").alias("_at")).agg(F.sum("_sum").alias("_more"))
        further = state.select(F.col("_node").alias("_via"), F.col("_up").alias("_next"))
        total = F.when(F.col("_more").isNull(), F.col("_sum")).otherwise(F.coalesce("_sum", F.lit(0.0)) + F.col("_more"))
        moved = state.join(below, F.col("_node") == F.col("_at"), "left").join(further, F.col("_up") == F.col("_via"), "left")
        old, state = state, stable(moved.select("_node", F.col("_next").alias("_up"), total.alias("_sum")))
        discard(old)
    out = df.select(*[quoted(c) for c in (id, pid, name, value)])
    return out.join(state.select("_node", F.col("_sum").alias("subtree_total")), quoted(id) == F.col("_node"), "left").drop("_node")


def _bin(v: Column, low: Column, high: Column) -> Column:
    """Number of the bin of a value in a range: the least and the greatest value have bins of their own."""
    inner = F.floor(F.try_divide(v / 2 - low / 2, high / 2 - low / 2) * (BINS - 2))
    inside = F.coalesce(F.greatest(F.lit(0), F.least(inner, F.lit(BINS - 3))), F.lit(0)) + 1
    return F.when(v == low, 0).when(v == high, BINS - 1).otherwise(inside).cast("int")


def quantile_cells(cells: DataFrame, keys: Sequence[str], v: str, quantiles: Sequence[float]) -> DataFrame:
    """The values at the ranks that the quantiles of each group need: (keys, _all, _rank, _low).

    A rank is sought in a range of values, at first that of its group. Each step counts the values
    of all open ranges in bins and goes on in the bin that holds the rank, until that bin
    holds one value only. The rows are neither sorted nor copied: a step is one narrow aggregate
    of at most ``BINS`` counts a range.
    """
    at = [(F.col("_all") - 1) * q for q in quantiles]
    ranks = F.array_distinct(F.array(*[whole(a).cast("long") for a in at for whole in (F.floor, F.ceil)]))
    spans = cells.groupBy(*[quoted(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_all"), F.min(v).alias("_low"), F.max(v).alias("_high")).where("_all > 0")
    sought = stable(spans.withColumn("_rank", F.explode(ranks)).withColumn("_left", F.col("_rank")))
    own = [*keys, "_low", "_high"]

    def same(names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [quoted(c).eqNullSafe(quoted(f"_at_{c}")) for c in names], F.lit(True))

    while not (live := sought.where("_low < _high")).isEmpty():
        ranges = live.select(*[quoted(c).alias(f"_at_{c}") for c in own]).distinct()
        if not keys:
            ranges = F.broadcast(ranges)  # two rows a quantile
        inside = cells.join(ranges, same(keys) & F.col(v).between(F.col("_at__low"), F.col("_at__high")))
        per_range = [quoted(f"_at_{c}") for c in own]
        counts = inside.groupBy(*per_range, _bin(F.col(v), F.col("_at__low"), F.col("_at__high")).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(v).alias("_from"), F.max(v).alias("_to"))
        before = F.sum("_n").over(Window.partitionBy(*per_range).orderBy("_bin")) - F.col("_n")
        held = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n"))
        moved = live.join(counts.withColumn("_before", before), same(own) & held).select(
            *[quoted(k) for k in keys], "_all", F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_rank",
            (F.col("_left") - F.col("_before")).alias("_left"))
        old, sought = sought, stable(sought.where("_low >= _high").unionByName(moved))
        discard(old)
    return sought.drop("_high", "_left")


def chart_box(df: DataFrame, dimension, value: str, mode: str = "rows") -> DataFrame:
    """Rows, or exact (low, q1, median, q3, high) per group by linear interpolation; missing values are left out."""
    keys = as_names(dimension)
    if _rows(df, [*keys, value], mode):
        return df.select(*[quoted(c) for c in (*keys, value)])
    v = quoted(value).cast("double").alias("_v")
    cells = df.select(*[quoted(k) for k in keys], v).where("_v is not null and not isnan(_v)")
    names = ("low", "q1", "median", "q3", "high")
    found = quantile_cells(cells, keys, "_v", QUARTILES)
    aggs = []
    for name, q in zip(names, QUARTILES, strict=True):
        at = (F.col("_all") - 1) * q
        below, above = [F.max(F.when(F.col("_rank") == whole(at), F.col("_low"))) for whole in (F.floor, F.ceil)]
        aggs.append((below + (above - below) * F.max(at - F.floor(at))).alias(name))
    return found.groupBy(*[quoted(k) for k in keys]).agg(*aggs)
