"""Fitted models small enough to be expressions, and their persistence."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.core.types import quoted
from tablewright.operators.histtrees import TreeModel


@dataclass(frozen=True)
class LinearModel:
    """One output: intercept + sum of coefficient * feature."""

    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    def expression(self, columns: Sequence[str] | None = None) -> Column:
        names = columns or self.features
        parts = [quoted(c).cast("double") * F.lit(float(w)) for c, w in zip(names, self.coef)]
        return reduce(lambda a, b: a + b, parts, F.lit(float(self.intercept)))

    def outputs(self, columns: Sequence[str] | None = None) -> list[Column]:
        return [self.expression(columns)]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expression())


@dataclass(frozen=True)
class MultiLinearModel:
    """Several linear outputs over the same features."""

    features: tuple[str, ...]
    labels: tuple[str, ...]
    coef: tuple[tuple[float, ...], ...]  # one row per label
    intercept: tuple[float, ...]

    def outputs(self, columns: Sequence[str] | None = None) -> list[Column]:
        return [LinearModel(self.features, c, b).expression(columns)
                for c, b in zip(self.coef, self.intercept)]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = [out] if len(self.labels) == 1 else [f"{out}_{y}" for y in self.labels]
        return df.withColumns(dict(zip(names, self.outputs())))


@dataclass(frozen=True)
class ExponentialModel:
    """a * exp(-b * x) + c."""

    feature: str
    a: float
    b: float
    c: float

    @property
    def features(self) -> tuple[str, ...]:
        return (self.feature,)

    def outputs(self, columns: Sequence[str] | None = None) -> list[Column]:
        x = quoted((columns or self.features)[0]).cast("double")
        e = F.exp(F.lit(-float(self.b)) * x)
        checked = F.when(e == F.lit(float("inf")), F.raise_error(
            F.lit("exp overflows: scale the input first")).cast("double")).otherwise(e)
        return [F.lit(float(self.a)) * checked + F.lit(float(self.c))]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.outputs()[0])


@dataclass(frozen=True)
class LogarithmModel:
    """a + b * log10(x)."""

    feature: str
    a: float
    b: float

    @property
    def features(self) -> tuple[str, ...]:
        return (self.feature,)

    def outputs(self, columns: Sequence[str] | None = None) -> list[Column]:
        x = quoted((columns or self.features)[0]).cast("double")
        return [F.lit(float(self.a)) + F.lit(float(self.b)) * F.log10(x)]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.outputs()[0])


@dataclass(frozen=True)
class WeibullModel:
    """Shape m and scale a of each peak."""

    m: tuple[float, ...]
    a: tuple[float, ...]


@dataclass
class SparkModel:
    """A fitted Spark ML transformer over an assembled feature vector."""

    features: tuple[str, ...]
    stage: Transformer
    prediction: str = "prediction"

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        vec = VectorAssembler(inputCols=list(self.features), outputCol="_features")
        done = self.stage.transform(vec.transform(df))
        kept = [quoted(c) for c in df.columns]
        return done.select(*kept, quoted(self.prediction).cast("double").alias(out))


CLOSED_FORM = {c.__name__: c for c in
               (LinearModel, MultiLinearModel, ExponentialModel, LogarithmModel, WeibullModel, TreeModel)}


def model_apply(df: DataFrame, model, out_fields: Sequence[str]) -> DataFrame:
    """Predict from all columns in order, renaming inputs and outputs by position.

    A Weibull model takes (time, total_cost) rows and returns its curve instead.
    """
    if isinstance(model, WeibullModel):
        from tablewright.operators.curvefit import weibull_curve

        return weibull_curve(df, model).toDF(*out_fields)
    k = len(df.columns)
    if isinstance(model, SparkModel):
        ready = df.toDF(*model.features)
        result = model.predict(ready, "_out")
    else:
        if k != len(model.features):
            raise ValueError(f"model takes {len(model.features)} columns, got {k}")
        outs = model.outputs(df.columns)
        result = df.select("*", *[o.alias(f"_out{i}") for i, o in enumerate(outs)])
    if len(out_fields) != len(result.columns):
        raise ValueError(f"{len(out_fields)} field names for {len(result.columns)} output columns")
    return result.toDF(*out_fields)


def _tuples(value):
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def model_versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Saved versions of a model name, oldest first."""
    fs, path = _hadoop(spark, f"{root}/{name}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))


def save_model(spark: SparkSession, model, root: str, name: str) -> int:
    """Save under ``root/name/v{n}`` with the next free version; returns it."""
    version = max(model_versions(spark, root, name), default=0) + 1
    base = f"{root}/{name}/v{version}"
    if isinstance(model, SparkModel):
        meta = {"kind": "SparkModel", "features": list(model.features), "prediction": model.prediction}
        PipelineModel([model.stage]).write().save(f"{base}/stage")
    else:
        meta = {"kind": type(model).__name__, "params": asdict(model)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.json(f"{base}/meta")
    return version


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None):
    """Load a version, by default the newest."""
    have = model_versions(spark, root, name)
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"no model {name} version {version}")
    base = f"{root}/{name}/v{version or have[-1]}"
    meta = json.loads(spark.read.schema("meta string").json(f"{base}/meta").first()[0])
    if meta["kind"] == "SparkModel":
        stage = PipelineModel.load(f"{base}/stage").stages[0]
        return SparkModel(tuple(meta["features"]), stage, meta["prediction"])
    return CLOSED_FORM[meta["kind"]](**{k: _tuples(v) for k, v in meta["params"].items()})
