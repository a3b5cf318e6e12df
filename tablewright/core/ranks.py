"""Exact cuts by rank from counting histograms: no sort, no copy of the rows.

Rows are ordered by a few digits below 65,536. For a cut at a rank, the rows are counted by
the first digit; the digit in which the rank falls is refined by the next one, and so on. Each
step is one narrow aggregate of at most 65,536 counts. What is left at the end are rows
that are equal in every digit, of which some go below the cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.core.types import quoted

DIGIT = 1 << 16


@dataclass(frozen=True)
class Cut:
    """Rows below ``path`` come first, then ``take`` of the ``size`` rows equal to it."""

    path: tuple[int, ...]
    take: int = 0
    size: int = 0


def row_digits(df: DataFrame, value: Column) -> list[Column]:
    """Digits of a number below 2^32, then those of a hash of the whole row (maps left out)."""
    plain = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    row = F.xxhash64(*plain)
    return [F.shiftright(value, 16).cast("int"), (value % DIGIT).cast("int"),
            *[F.shiftrightunsigned(row, 48 - 16 * k).cast("bigint").bitwiseAND(DIGIT - 1).cast("int") for k in range(4)]]


def cut_at(df: DataFrame, digits: Sequence[Column], rank: int) -> Cut:
    """The cut with ``rank`` rows before it."""
    rows = df.select(*[d.alias(f"d{k}") for k, d in enumerate(digits)])
    path: list[int] = []
    size = 0
    for k in range(len(digits)):
        counts = sorted((r[0], r[1]) for r in rows.groupBy(f"d{k}").count().collect())
        for digit, size in counts:
            if rank < size:
                break
            rank -= size
        else:
            return Cut((DIGIT,))  # beyond the last row
        path.append(digit)
        if rank == 0:
            return Cut(tuple(path))
        rows = rows.where(F.col(f"d{k}") == digit)
    return Cut(tuple(path), rank, size)


def _equal(digits: Sequence[Column], path: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [d == v for d, v in zip(digits, path, strict=False)], F.lit(True))


def _below(digits: Sequence[Column], path: Sequence[int]) -> Column:
    return reduce(lambda a, b: a | b, [_equal(digits, path[:k]) & (digits[k] < path[k]) for k in range(len(path))])


def between(df: DataFrame, digits: Sequence[Column], low: Cut | None, high: Cut | None) -> DataFrame:
    """The rows from one cut up to another; None: from the first, or to the last row."""
    inside = _below(digits, high.path) if high else F.lit(True)
    parts = []
    if low:
        inside = inside & ~_below(digits, low.path)
    if low and low.take:
        same = _equal(digits, low.path)
        inside = inside & ~same
        upto = high.take if high and high.path == low.path else low.size
        parts.append(df.where(same).limit(upto - low.take))
    if high and high.take and not (low and low.path == high.path and low.take):
        parts.append(df.where(_equal(digits, high.path)).limit(high.take))
    return reduce(DataFrame.unionAll, parts, df.where(inside))
