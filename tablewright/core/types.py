"""Logical column types, roles, scaler state and the dataset they travel in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

VARCHAR2 = "VARCHAR2"
NUMBER = "NUMBER"
DATE = "DATE"

# The Spark type used for each logical type.
LOGICAL_TO_SPARK: dict[str, T.DataType] = {
    VARCHAR2: T.StringType(),
    NUMBER: T.DoubleType(),
    DATE: T.TimestampNTZType(),
}

# The Spark type used for each storage type of a managed table.
STORAGE_TO_SPARK: dict[str, T.DataType] = {
    "VARCHAR2": T.StringType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIME": T.StringType(),
    "INT": T.LongType(),
    "DECIMAL": T.DecimalType(38, 10),
    "BLOB": T.BinaryType(),
    "CLOB": T.StringType(),
}

# Logical type -> storage type.
LOGICAL_TO_STORAGE = {VARCHAR2: "VARCHAR2", NUMBER: "DECIMAL", DATE: "DATETIME"}

# Vendor type name -> logical type; unknown names are VARCHAR2.
VENDOR_NUMBER = (
    "numeric decimal number dec bit integer int bigint tinyint byte smallint "
    "binary varbinary float double real double_precision longvarbinary"
).split()
VENDOR_DATE = "date timestamp datetime".split()


class SchemaError(ValueError):
    """A table does not have the columns or types an operator asked for."""


def vendor_to_logical(name: str) -> str:
    """Logical type of a database vendor's type name."""
    key = name.strip().lower().replace(" ", "_").split("(")[0]
    if key in VENDOR_NUMBER:
        return NUMBER
    if key in VENDOR_DATE:
        return DATE
    return VARCHAR2


def to_logical(dtype: T.DataType) -> str:
    """Logical type of a Spark type."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return NUMBER
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return VARCHAR2


def spark_type(name: str) -> T.DataType:
    """Spark type of a logical or storage type name."""
    if name in LOGICAL_TO_SPARK:
        return LOGICAL_TO_SPARK[name]
    if name in STORAGE_TO_SPARK:
        return STORAGE_TO_SPARK[name]
    raise SchemaError(f"unknown type {name!r}")


def fields(df: DataFrame) -> list[dict[str, str]]:
    """Field descriptors (name, nick_name, data_type) of a DataFrame."""
    return [
        {
            "name": f.name,
            "nick_name": f.metadata.get("nick_name", f.name),
            "data_type": to_logical(f.dataType),
        }
        for f in df.schema.fields
    ]


def with_nick_names(df: DataFrame, nick_names: Mapping[str, str]) -> DataFrame:
    """Attach display names as column metadata."""
    for name, nick in nick_names.items():
        old = df.schema[name].metadata
        df = df.withMetadata(name, {**old, "nick_name": nick})
    return df


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing}; have {df.columns}")


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    names = list(names)
    require_columns(df, names)
    bad = [n for n in names if to_logical(df.schema[n].dataType) != NUMBER]
    if bad:
        raise SchemaError(f"columns {bad} are not numeric")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def known(name: str) -> Column:
    """A numeric column with NaN as null, for aggregates."""
    return F.when(~F.isnan(quoted(name)), quoted(name))


def quoted(name: str):
    """Column reference that is safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Roles:
    """Which columns are features (x) and which are labels (y)."""

    x: tuple[str, ...] = ()
    y: tuple[str, ...] = ()

    def keep(self, names: Sequence[str]) -> "Roles":
        return Roles(tuple(c for c in self.x if c in names), tuple(c for c in self.y if c in names))

    def rename(self, mapping: Mapping[str, str]) -> "Roles":
        return Roles(
            tuple(mapping.get(c, c) for c in self.x), tuple(mapping.get(c, c) for c in self.y)
        )


Scaler = dict[str, tuple[float, float]]


@dataclass(frozen=True)
class Dataset:
    """A DataFrame together with its roles and min-max scaler state."""

    df: DataFrame
    roles: Roles = field(default_factory=Roles)
    scaler: Scaler = field(default_factory=dict)

    def with_df(self, df: DataFrame) -> "Dataset":
        """Replace the table, dropping roles and scaler entries of lost columns."""
        return replace(
            self,
            df=df,
            roles=self.roles.keep(df.columns),
            scaler={k: v for k, v in self.scaler.items() if k in df.columns},
        )

    def rename(self, mapping: Mapping[str, str]) -> "Dataset":
        return Dataset(
            self.df.withColumnsRenamed(dict(mapping)),
            self.roles.rename(mapping),
            {mapping.get(k, k): v for k, v in self.scaler.items()},
        )
