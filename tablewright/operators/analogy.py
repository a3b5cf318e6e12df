"""Estimation by analogy: blend the three most similar known rows.

Similarity is the weighted Jaccard ratio sum(min) / sum(max) of scaled features.
Known rows that lie near each other share a block of fixed size, described by the
bounds of its features; the bounds cap the similarity that any of its rows can reach.
A target is sent to the blocks whose cap is not below what it is sure to reach, and is
compared there with the block's rows at once; only its three best of each block go on.
So rows of the two tables are never paired in a join or a shuffle, at any number of
features, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.core.layout import row_index
from tablewright.core.session import stable
from tablewright.core.types import quoted, require_numeric

BLOCK_ROWS = 2_000  # known rows compared at once
SLICE_ROWS = 100_000  # targets that one task compares with a block
SURE_ROWS = 4_096  # known rows that give every target a first bound
BOXES = 20_000  # block descriptions sent out at once
_DIGITS = 5


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _similarities(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Similarity of every row of ``u`` with every row of ``v``."""
    low, high = np.zeros((len(u), len(v))), np.zeros((len(u), len(v)))
    for i in range(u.shape[1]):
        low += np.minimum(u[:, i, None], v[None, :, i])
        high += np.maximum(u[:, i, None], v[None, :, i])
    return np.divide(low, high, out=np.zeros_like(low), where=high > 0)


def _three_best(sim: np.ndarray) -> np.ndarray:
    """Columns of the three greatest of each row, of equal ones the first."""
    sim = sim.copy()
    top, rows = [], np.arange(len(sim))
    for _ in range(min(3, sim.shape[1])):
        top.append(sim.argmax(axis=1))
        sim[rows, top[-1]] = -1.0
    return np.column_stack(top)


def _caps(u: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The most similar that any row inside a box can be to a row of ``u``."""
    low, high = np.zeros((len(u), len(lo))), np.zeros((len(u), len(lo)))
    for i in range(u.shape[1]):
        low += np.minimum(u[:, i, None], hi[None, :, i])
        high += np.maximum(u[:, i, None], lo[None, :, i])
    return np.divide(low, high, out=np.zeros_like(low), where=high > 0)


def analogy_weights(base: DataFrame, x: Sequence[str]) -> dict[str, float]:
    """Share of each feature in the total of all features over the known rows."""
    row = base.agg(*[F.sum(quoted(c)) for c in x]).first()
    total = sum(row)
    return {c: row[i] / total for i, c in enumerate(x)}


def _routed(wanted: DataFrame, blocks: DataFrame, sure: np.ndarray, vecs: list[str], aims: list[str]) -> DataFrame:
    """``_tid``, the features and ``_block`` of each target and block that may hold one of its best rows."""
    bounds = blocks.groupBy("_block").agg(*[f(v).alias(f"_{n}{i}") for i, v in enumerate(vecs) for n, f in (("lo", F.min), ("hi", F.max))])
    schema = ", ".join(["_tid long", *[f"{u} double" for u in aims], "_block long"])
    p, out = len(vecs), None

    def route(boxes: np.ndarray):
        names, lo, hi = boxes[:, 0].astype(np.int64), boxes[:, 1::2], boxes[:, 2::2]

        def run(batches):
            for batch in batches:
                u = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(p)])
                for start in range(0, len(u), 64):
                    part = u[start:start + 64]
                    least = np.zeros(len(part))
                    if len(sure) >= 3:  # rounding may lift a row by half a unit of the last digit
                        least = np.partition(_similarities(part, sure), -3, axis=1)[:, -3] - 10.0**-_DIGITS
                    row, box = np.nonzero(_caps(part, lo, hi) >= least[:, None])
                    ids = batch.column(0).take(pa.array(row + start))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(part[row, i]) for i in range(p)], pa.array(names[box])],
                                                     names=["_tid", *aims, "_block"])

        return run

    # Few targets lie in one file, but each meets every block's bounds: deal them out.
    wanted = wanted.repartition(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_tid")
    held: list[list] = []
    rows = bounds.select("_block", *[f"_{n}{i}" for i in range(p) for n in ("lo", "hi")]).toLocalIterator()  # a row for each 2,000 known ones
    for r in rows:
        held.append([float(v) for v in r])
        if len(held) == BOXES:
            part = wanted.select("_tid", *aims).mapInArrow(route(np.array(held)), schema)
            out, held = part if out is None else out.unionAll(part), []
    if held or out is None:
        part = wanted.select("_tid", *aims).mapInArrow(route(np.array(held).reshape(-1, 1 + 2 * p)), schema)
        out = part if out is None else out.unionAll(part)
    return out


def analogy(base: DataFrame, targets: DataFrame, x: Sequence[str], y: str, weights: Mapping[str, float],
            L: float = 1.0, order_by: str | None = None) -> DataFrame:
    """Estimate ``y`` for every target row from its three most similar base rows.

    Ties in similarity (rounded to 5 digits) go to the earlier row of ``order_by``.
    Features and weights must not be negative.
    """
    x = list(x)
    require_numeric(base, [*x, y])
    require_numeric(targets, x)
    order_by = order_by or x[0]
    pool = base.select(*[quoted(c) for c in x], F.lit(1).alias("_known")).unionByName(
        targets.select(*[quoted(c) for c in x], F.lit(0).alias("_known")))
    stats = pool.agg(F.sum("_known"), *[f(quoted(c)) for c in x for f in (F.min, F.max)]).first()
    n_base, lows, tops = stats[0] or 0, stats[1::2], stats[2::2]
    if not n_base:
        raise ValueError("no known rows")
    if any(v is None or v < 0 for v in lows) or any(weights[c] < 0 for c in x):
        raise ValueError("features and weights must be present and not negative")
    scaled = {c: F.coalesce(F.try_divide(quoted(c).cast("double"), F.lit(float(tops[i]))), F.lit(0.0))
              * F.lit(float(weights[c])) for i, c in enumerate(x)}
    vecs = [f"_v{i}" for i in range(len(x))]
    known = base.select(*[scaled[c].alias(v) for c, v in zip(x, vecs)],
                        quoted(order_by).alias("_ord"), quoted(y).cast("double").alias("_y"))
    # Rows with equal features tie, so only the first three of them can be chosen.
    same = Window.partitionBy(*vecs).orderBy("_ord")
    known = known.withColumn("_r", F.row_number().over(same)).where("_r <= 3").drop("_r")
    wanted = targets.select(*[quoted(c).alias(f"_t_{c}") for c in x],
                            *[scaled[c].alias(f"_u{i}") for i, c in enumerate(x)]).distinct()
    aims = [f"_u{i}" for i in range(len(x))]

    wanted = stable(wanted.withColumn("_tid", F.monotonically_increasing_id()))
    # Near rows share a block: order by coarse steps of the features, the heaviest first.
    heavy = sorted(range(len(x)), key=lambda i: -weights[x[i]])
    near = [F.floor(F.col(vecs[i]) / F.lit(max(float(weights[x[i]]), 1e-12)) * 8) for i in heavy]
    blocks = stable(row_index(known, [*near, *vecs, "_ord"], name="_at").withColumn("_block", F.floor((F.col("_at") - 1) / BLOCK_ROWS)))
    sure = np.array([list(r) for r in blocks.orderBy(F.xxhash64(*vecs), "_at").limit(SURE_ROWS).select(*vecs).collect()], dtype=float)
    found = _routed(wanted, blocks, sure, vecs, aims)
    copies = max(1, -(-wanted.count() // SLICE_ROWS))
    shared = blocks.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def best_of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["_tid", "_sim", "_ord", "_y"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        right = right.sort_values("_ord", kind="stable")  # earlier rows first, so they win ties
        u, v, out = left[aims].to_numpy(float), right[vecs].to_numpy(float), []
        for start in range(0, len(u), 64):
            sim = np.floor(_similarities(u[start:start + 64], v) * 10**_DIGITS + 0.5) / 10**_DIGITS
            top = _three_best(sim)
            part = right.iloc[top.ravel()]
            ids = np.repeat(left["_tid"].to_numpy()[start:start + 64], top.shape[1])
            out.append(pd.DataFrame({"_tid": ids, "_sim": np.take_along_axis(sim, top, 1).ravel(),
                                     "_ord": part["_ord"].to_numpy(), "_y": part["_y"].to_numpy()}))
        return pd.concat(out)

    routed = found.withColumn("_slice", (F.col("_tid") % copies).cast("int"))
    best_rows = routed.groupBy("_block", "_slice").cogroup(shared.groupBy("_block", "_slice")).applyInPandas(
        best_of_block, f"_tid long, _sim double, _ord {types['_ord']}, _y double")
    keys = [f"_t_{c}" for c in x]
    best = Window.partitionBy("_tid").orderBy(F.col("_sim").desc(), "_ord")
    top = best_rows.withColumn("_r", F.row_number().over(best)).where("_r <= 3")

    def at(rank: int, name: str) -> Column:
        return F.max(F.when(F.col("_r") == rank, F.col(name)))

    chosen = top.groupBy("_tid").agg(*[at(k, c).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("_sim", "_y")]).join(
        wanted.select("_tid", *keys), "_tid")
    b = {k: F.col(f"_sim{k}") for k in (1, 2, 3)}
    e = {k: F.col(f"_y{k}") for k in (1, 2, 3)}
    one = b[1] * e[1]
    two = one + (1 - b[1]) * b[2] * e[2]
    rest = (1 - b[1]) * (1 - b[2])
    three = two + rest * b[3] * e[3] + rest * (1 - b[3]) * (e[1] + e[2] + e[3]) / 3
    blend = F.when(b[2].isNull(), one).when(b[3].isNull(), two).otherwise(three)
    chosen = chosen.select(*keys, (F.lit(float(L)) * blend).alias("_est"))
    cond = [quoted(c) == F.col(f"_t_{c}") for c in x]
    out = targets.drop(y).join(chosen, cond, "left")
    return out.select(*[quoted(c) for c in targets.columns if c != y], F.col("_est").alias(y))
