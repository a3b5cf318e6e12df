"""User functions registered by name: table functions and model trainers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablewright.core.layout import as_names

_REGISTRY: dict[str, Callable] = {}


def register(name: str, fn: Callable) -> Callable:
    """Register ``fn(*DataFrames, **params) -> DataFrame or model`` under a name."""
    if not callable(fn):
        raise TypeError("register a callable")
    _REGISTRY[name] = fn
    return fn


def registered() -> list[str]:
    return sorted(_REGISTRY)


def apply_custom(name: str, *dfs: DataFrame, **params):
    """Run a registered function over its input tables."""
    if name not in _REGISTRY:
        raise KeyError(f"nothing registered as {name!r}")
    return _REGISTRY[name](*dfs, **params)


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Row-wise pandas code over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def fit_per_group(df: DataFrame, by, partial: Callable[[pd.DataFrame], object], merge: Callable[[object, object], object],
                  finish: Callable[[tuple, object], dict], schema: str, fan_in: int = 64) -> DataFrame:
    """User training code per group, for groups of any size.

    ``partial`` makes a state from some rows of a group, ``merge`` joins two states, and
    ``finish(key, state)`` gives the output row. States are made per Arrow batch, joined in
    each task, then ``fan_in`` at a time, so no task ever holds the rows of a whole group.
    """
    keys = as_names(by)
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    states = f"{key_fields}, _state binary, _slot bigint"

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held = TaskContext.get().partitionId(), {}
        for pdf in frames:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                state = partial(rows)
                held[key] = merge(held[key], state) if key in held else state
        yield _frame([(*key, pickle.dumps(state), task) for key, state in held.items()])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*keys, "_state", "_slot"])

    def joined(states: pd.Series) -> object:
        return reduce(merge, map(pickle.loads, states))

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([(*key[:-1], pickle.dumps(joined(pdf["_state"])), int(key[-1]))])

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([finish(key, joined(pdf["_state"]))])

    made = df.mapInPandas(first, states)
    # A group has one state a task; a level joins fan_in of them, so three levels join fan_in ** 3.
    for _ in range(2):
        made = made.withColumn("_slot", F.floor(F.col("_slot") / fan_in)).groupBy(*keys, "_slot").applyInPandas(together, states)
    return made.groupBy(*keys).applyInPandas(last, schema)
