"""Projection, filtering, type conversion, joins, ranking and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.core.layout import as_names, row_index
from tablewright.core.types import (
    DATE, NUMBER, VARCHAR2, Dataset, Roles, SchemaError, quoted, require_columns, to_logical,
)
from tablewright.functions.convert import to_date_column, to_number_column, to_text_column
from tablewright.functions.expressions import compile_expression

# Comparators of a filter.
COMPARATORS = {
    "great_than": lambda c, v: c > v,
    "great_than_or_equal": lambda c, v: c >= v,
    "equal": lambda c, v: c == v,
    "less_than": lambda c, v: c < v,
    "less_than_or_equal": lambda c, v: c <= v,
    "not_equal": lambda c, v: c != v,
}


def column_filter(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep the listed columns in table order; unknown names are ignored."""
    return df.select(*[quoted(c) for c in df.columns if c in set(keep)])


def column_add(df: DataFrame, expressions: Sequence[tuple[str, str]]) -> DataFrame:
    """Add numeric columns in order; later expressions see earlier results."""
    for name, expression in expressions:
        df = df.withColumn(name, compile_expression(expression, df.columns).cast("double"))
    return df


def type_convert(df: DataFrame, to: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Convert columns to NUMBER, DATE or VARCHAR2; names match case-insensitively."""
    wanted = {k.lower(): v for k, v in to.items()}
    out = {}
    for f in df.schema.fields:
        target = wanted.get(f.name.lower())
        col, source = quoted(f.name), to_logical(f.dataType)
        if target == NUMBER:
            out[f.name] = to_number_column(col, source == DATE, strict)
        elif target == DATE:
            out[f.name] = col if source == DATE else to_date_column(col, strict)
        elif target == VARCHAR2:
            is_float = isinstance(f.dataType, (T.FloatType, T.DoubleType))
            out[f.name] = to_text_column(col, is_float)
        elif target is not None:
            raise SchemaError(f"unknown type {target!r}")
    return df.withColumns(out) if out else df


def _literal(value, logical: str) -> Column:
    if logical == NUMBER:
        return F.lit(float(value) if value else 0.0)
    if logical == DATE:
        return F.to_timestamp_ntz(F.lit(value), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.lit(value)


def _resolve(df: DataFrame, name: str) -> str:
    for candidate in (name, name.lower()):
        if candidate in df.columns:
            return candidate
    raise SchemaError(f"missing column {name!r}")


def predicate(df: DataFrame, rule: tuple) -> Column:
    """Condition for one (column, type, comparator, value) rule."""
    name, logical, comparator, *rest = rule
    actual = _resolve(df, name)
    col = quoted(actual)
    null = col.isNull()
    if isinstance(df.schema[actual].dataType, (T.FloatType, T.DoubleType)):
        null = null | F.isnan(col)  # NaN is missing too
    if comparator == "is_null":
        return null
    if comparator == "is_not_null":
        return ~null
    if comparator not in COMPARATORS:
        raise SchemaError(f"unknown comparator {comparator!r}")
    holds = COMPARATORS[comparator](col, _literal(rest[0] if rest else None, logical))
    if isinstance(df.schema[actual].dataType, (T.FloatType, T.DoubleType)):
        return holds & ~F.isnan(col)
    return holds


def data_filter(df: DataFrame, rules: Sequence[tuple], mode: str = "all") -> DataFrame:
    """Rows matching all rules, or any of them; no rules keeps every row."""
    if not rules:
        return df
    parts = [predicate(df, r) for r in rules]
    return df.where(reduce(and_ if mode == "all" else or_, parts))


def role_setting(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> Dataset:
    """Tag features and labels; the data is unchanged."""
    require_columns(df, [*x, *y])
    return Dataset(df, Roles(tuple(x), tuple(y)))


def roles_table(data: Dataset) -> DataFrame:
    """The role tags as a table."""
    fields = {f.name: f.metadata.get("nick_name", f.name) for f in data.df.schema.fields}
    rows = [(c, fields.get(c, c), "X") for c in data.roles.x]
    rows += [(c, fields.get(c, c), "Y") for c in data.roles.y]
    return data.df.sparkSession.createDataFrame(rows, "name string, nick_name string, role_type string")


def replicate(df: DataFrame, n: int) -> list[DataFrame]:
    """The same lazy table for n consumers."""
    return [df] * n


def rename(df: DataFrame, names: Mapping[str, str] | Sequence[str] | None = None,
           prefix: str = "", suffix: str = "") -> DataFrame:
    """Rename by mapping, by position, or with a prefix and suffix."""
    if isinstance(names, Mapping):
        return df.withColumnsRenamed(dict(names))
    if names is not None:
        if len(names) != len(df.columns):
            raise SchemaError(f"{len(names)} names for {len(df.columns)} columns")
        return df.toDF(*names)
    return df.toDF(*[f"{prefix}{c}{suffix}" for c in df.columns])


def data_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "full",
              display: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_l", "_r"),
              null_safe: bool = True) -> DataFrame:
    """Single-key join; null keys match each other unless ``null_safe`` is off.

    Columns get a side suffix; ``display`` names the suffixed columns to keep.
    Adaptive execution splits hot keys on both sides of an inner join only, so outer
    joins are an inner join plus the unmatched rows of either side, found against the
    distinct keys of the other.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"unknown join {how!r}")
    a, b = rename(left, suffix=suffixes[0]), rename(right, suffix=suffixes[1])
    ka, kb = quoted(left_on + suffixes[0]), quoted(right_on + suffixes[1])
    match = ka.eqNullSafe(kb) if null_safe else ka == kb
    out = a.join(b, match, "inner")
    if how != "inner":
        out = out.unionByName(a.join(b.select(kb).distinct(), match, "left_anti"), allowMissingColumns=True)
    if how == "full":
        out = out.unionByName(b.join(a.select(ka).distinct(), match, "left_anti"), allowMissingColumns=True)
    if display is None:
        return out
    keep = [c for c in sorted(out.columns) if c in set(display)]
    return out.select(*[quoted(c) for c in keep])


def join_datasets(left: Dataset, right: Dataset, left_on: str, right_on: str, how: str = "full",
                  display: Sequence[str] | None = None,
                  suffixes: tuple[str, str] = ("_l", "_r")) -> Dataset:
    """``data_join`` that also carries roles and scaler entries along."""
    a = left.rename({c: c + suffixes[0] for c in left.df.columns})
    b = right.rename({c: c + suffixes[1] for c in right.df.columns})
    df = data_join(left.df, right.df, left_on, right_on, how, display, suffixes)
    roles = Roles(a.roles.x + b.roles.x, a.roles.y + b.roles.y)
    return Dataset(df, roles, {**a.scaler, **b.scaler}).with_df(df)


def latest_per_key(df: DataFrame, key, order_by: Sequence[Column]) -> DataFrame:
    """First row per key in the given order."""
    return top_k_per_group(df, key, order_by, 1)


def top_k_per_group(df: DataFrame, key, order_by: Sequence[Column], k: int,
                    rank: str | None = None) -> DataFrame:
    """The first k rows per key; the rank limit also runs before the shuffle."""
    w = Window.partitionBy(*as_names(key)).orderBy(*order_by)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= k)
    return out if rank else out.drop("_rank")


def rank_by_score(df: DataFrame, score: str, tie: str, name: str = "ranking") -> DataFrame:
    """Rank of every row by falling score; ties rank in ``tie`` order."""
    return row_index(df, [F.col(score).desc(), F.col(tie).asc()], name=name)


def union_all(df: DataFrame, other: DataFrame, fill: Mapping[str, float] | None = None) -> DataFrame:
    """Union by name; columns one side lacks are null there, or ``fill``."""
    out = df.unionByName(other, allowMissingColumns=True)
    if not fill:
        return out
    missing = {c: v for c, v in fill.items() if c not in other.columns or c not in df.columns}
    return out.fillna(missing) if missing else out


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs).distinct()


def distinct_by(df: DataFrame, key, order_by: Sequence[Column] | None = None) -> DataFrame:
    """One row per key: the first in ``order_by``, or any row."""
    names = as_names(key)
    return top_k_per_group(df, names, order_by, 1) if order_by else df.dropDuplicates(names)
