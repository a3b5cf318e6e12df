"""Flows: named inputs, named outputs, used whole or as one step of another flow."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tablewright.sources.sinks import publish


class Flow:
    """A function from named tables to a dict of named tables or models.

    Nothing runs until an output is used, so asking for one output never
    computes the others.
    """

    def __init__(self, fn: Callable[..., dict], name: str | None = None):
        self.fn, self.name = fn, name or fn.__name__
        self.inputs = [p.name for p in inspect.signature(fn).parameters.values()
                       if p.kind is not inspect.Parameter.VAR_KEYWORD]

    def run(self, **inputs) -> dict:
        unknown = [k for k in inputs if k not in self.inputs]
        if unknown:
            raise TypeError(f"{self.name} has no inputs {unknown}")
        out = self.fn(**inputs)
        if not isinstance(out, dict):
            raise TypeError(f"{self.name} must return a dict of named outputs")
        return out

    def run_in_order(self, *tables) -> dict:
        """Bind tables to the inputs by position."""
        return self.run(**dict(zip(self.inputs, tables)))

    def run_to(self, output: str, **inputs):
        """Only one output; the plans of the others are never executed."""
        return self.run(**inputs)[output]

    def publish(self, prefix: str = "", **inputs) -> dict:
        out = self.run(**inputs)
        publish({k: v for k, v in out.items() if isinstance(v, DataFrame)}, prefix)
        return out


def insight(df: DataFrame, n: int = 100, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows of an output."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def insight_summary(df: DataFrame) -> DataFrame:
    """(name, rows, missing, low, high) per column, in one pass; limits as text."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        col = F.col("`" + c + "`")
        aggs += [F.count(col).alias(f"_c{i}"), F.min(col).cast("string").alias(f"_l{i}"),
                 F.max(col).cast("string").alias(f"_h{i}")]
    cells = [F.struct(F.lit(c).alias("name"), F.col("_n").alias("rows"),
                      (F.col("_n") - F.col(f"_c{i}")).alias("missing"), F.col(f"_l{i}").alias("low"),
                      F.col(f"_h{i}").alias("high")) for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))
