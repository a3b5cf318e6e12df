"""Distributed first and second moments: the basis of every closed-form fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.core.types import quoted, require_numeric

# Up to this many columns all covariances fit one generated aggregate.
EXPRESSION_LIMIT = 12


@dataclass
class Moments:
    """Row count, means and centred cross-products of some columns."""

    columns: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def pick(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        i = [self.columns.index(c) for c in rows]
        j = [self.columns.index(c) for c in cols]
        return self.cross[np.ix_(i, j)]

    def mean_of(self, cols: Sequence[str]) -> np.ndarray:
        return self.mean[[self.columns.index(c) for c in cols]]

    def merge(self, other: "Moments") -> "Moments":
        """Moments of the union of two disjoint row sets."""
        n = self.n + other.n
        if n == 0:
            return self
        d = other.mean - self.mean
        cross = self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n)
        return Moments(self.columns, n, self.mean + d * (other.n / n), cross)

    def std(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cross) / (self.n - 1))

    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.diag(self.cross))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = self.cross / np.outer(s, s)
        np.fill_diagonal(r, 1.0)
        return r


def moment_aggregates(columns: Sequence[str]) -> list:
    """Aggregate expressions whose one-row result ``moments_of_row`` understands."""
    out = [F.count(F.lit(1)).alias("_n")]
    out += [F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(columns)]
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            out.append(F.covar_pop(quoted(a), quoted(columns[j])).alias(f"_c{i}_{j}"))
    return out


def moments_of_row(row, columns: Sequence[str]) -> Moments:
    p = len(columns)
    n = float(row["_n"])
    if n == 0:
        return Moments(list(columns), 0.0, np.zeros(p), np.zeros((p, p)))
    mean = np.array([row[f"_m{i}"] for i in range(p)], dtype=float)
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cross[i, j] = cross[j, i] = float(row[f"_c{i}_{j}"]) * n
    return Moments(list(columns), n, mean, cross)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over the rows that are complete in ``columns``.

    Few columns: one pass of JVM covariance aggregates. Many columns: means
    first, then p-by-p blocks per Arrow batch that add up in one shuffle of
    p*p keys.
    """
    columns = list(dict.fromkeys(columns))
    require_numeric(df, columns)
    rows = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).na.drop()
    if len(columns) <= EXPRESSION_LIMIT:
        return moments_of_row(rows.agg(*moment_aggregates(columns)).first(), columns)
    head = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)) for c in columns]).first()
    n, mean = float(head[0]), np.array([v or 0.0 for v in head[1:]], dtype=float)
    p = len(columns)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(p * p)), pa.array(total.ravel())], names=["pos", "val"]
        )

    sums = rows.mapInArrow(blocks, "pos long, val double").groupBy("pos").agg(F.sum("val"))
    cross = np.zeros(p * p)
    for pos, val in sums.collect():  # p*p rows whatever the table size
        cross[pos] = val
    return Moments(columns, n, mean, cross.reshape(p, p))


def grouped_moments(df: DataFrame, columns: Sequence[str], by: str, groups: int) -> dict:
    """Moments per value of a small grouping column with at most ``groups`` values."""
    columns = list(dict.fromkeys(columns))
    rows = df.select(by, *[quoted(c).cast("double").alias(c) for c in columns]).na.drop()
    if len(columns) <= EXPRESSION_LIMIT:
        got = rows.groupBy(by).agg(*moment_aggregates(columns)).limit(groups + 1).collect()
        if len(got) > groups:
            raise ValueError(f"more than {groups} values in {by}")
        return {r[by]: moments_of_row(r, columns) for r in got}
    keys = [r[0] for r in rows.select(by).distinct().limit(groups + 1).collect()]
    if len(keys) > groups:
        raise ValueError(f"more than {groups} values in {by}")
    return {k: moments(rows.where(F.col(by) == F.lit(k)), columns) for k in keys}


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form: (a, b, r)."""
    m = moments(df, columns)
    r = m.correlation()
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(m.columns) for j, b in enumerate(m.columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
