"""Model evaluation: every metric of a table from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablewright.core.gram import moments
from tablewright.core.numeric import f_ppf
from tablewright.core.types import quoted, require_numeric

REGRESSION_METRICS = ("r2", "mse", "rmse", "mae")
CLASSIFICATION_METRICS = ("precision", "recall", "f1", "kappa")


def _as_rows(one: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One-row metrics to (evaluate, value) rows."""
    rows = [F.struct(F.lit(m).alias("evaluate"), F.col(m).cast("double").alias("value")) for m in metrics]
    return one.select(F.inline(F.array(*rows)))


def regression_evaluate(df: DataFrame, y: str, pred: str,
                        metrics: Sequence[str] = REGRESSION_METRICS) -> DataFrame:
    """(evaluate, value) rows of r2, mse, rmse and mae over the rows that have both values."""
    require_numeric(df, [y, pred])
    unknown = [m for m in metrics if m not in REGRESSION_METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    t, e = quoted(y).cast("double"), quoted(y).cast("double") - quoted(pred).cast("double")
    one = df.where(t.isNotNull() & e.isNotNull() & ~F.isnan(e)).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(t).alias("_var"))
    perfect = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_var") == 0, perfect).otherwise(1 - F.try_divide("mse", "_var"))
    one = one.withColumns({"rmse": F.sqrt("mse"), "r2": r2})
    return _as_rows(one, metrics)


def icc(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Six intraclass correlations of truth and prediction as two raters, with 95 % limits."""
    m = moments(df, [y, pred])
    n, k = m.n, 2
    cyy, cyp, cpp = m.cross[0, 0], m.cross[0, 1], m.cross[1, 1]
    gap = float(m.mean[0] - m.mean[1])
    between = (cyy + 2 * cyp + cpp) / 2 / (n - 1)
    raters = n * gap**2 / 2
    residual = (cyy - 2 * cyp + cpp) / 2 / (n - 1)
    within = ((cyy - 2 * cyp + cpp) / 2 + n * gap**2 / 2) / n
    icc1 = (between - within) / (between + (k - 1) * within)
    icc2 = (between - residual) / (between + (k - 1) * residual + k * (raters - residual) / n)
    icc3 = (between - residual) / (between + (k - 1) * residual)
    icc1k = (between - within) / between
    icc2k = (between - residual) / (between + (raters - residual) / n)
    icc3k = (between - residual) / between
    q, df1 = 0.975, n - 1
    dfw, dfe = n * (k - 1), (n - 1) * (k - 1)
    inf = float("inf")
    f1 = between / within if within else inf
    f3 = between / residual if residual else inf
    lo1, up1 = f1 / f_ppf(q, df1, dfw), f1 * f_ppf(q, dfw, df1)
    lo3, up3 = f3 / f_ppf(q, df1, dfe), f3 * f_ppf(q, dfe, df1)

    def single(v: float) -> float:
        return 1.0 if v == inf else (v - 1) / (v + k - 1)

    def average(v: float) -> float:
        return 1.0 if v == inf else 1 - 1 / v

    if residual:
        fj = raters / residual
        inner = n * (1 + (k - 1) * icc2) - k * icc2
        v = dfe * (k * icc2 * fj + inner) ** 2 / (df1 * k**2 * icc2**2 * fj**2 + inner**2)
        hi, lo = f_ppf(q, df1, v), f_ppf(q, v, df1)
        rest = k * raters + (k * n - k - n) * residual
        lo2 = n * (between - hi * residual) / (hi * rest + n * between)
        up2 = n * (lo * between - residual) / (rest + n * lo * between)
    else:
        lo2 = up2 = icc2

    def stepped(v: float) -> float:
        return v * k / (1 + v * (k - 1))

    rows = [
        ("ICC1", "Single raters absolute", icc1, single(lo1), single(up1)),
        ("ICC2", "Single random raters", icc2, lo2, up2),
        ("ICC3", "Single fixed raters", icc3, single(lo3), single(up3)),
        ("ICC1k", "Average raters absolute", icc1k, average(lo1), average(up1)),
        ("ICC2k", "Average random raters", icc2k, stepped(lo2), stepped(up2)),
        ("ICC3k", "Average fixed raters", icc3k, average(lo3), average(up3)),
    ]
    out = [(t, d, float(v), round(float(a), 2), round(float(b), 2)) for t, d, v, a, b in rows]
    return df.sparkSession.createDataFrame(
        out, "type string, description string, icc double, ci_low double, ci_high double")


def _label_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per label: rows where a has it, where b has it, where both do."""
    cells = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col("_a").alias("label"), F.col("_n").alias("in_a"), F.lit(0).cast("long").alias("in_b"),
                 F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_n")).otherwise(F.lit(0)).alias("both")),
        F.struct(F.col("_b").alias("label"), F.lit(0).cast("long").alias("in_a"), F.col("_n").alias("in_b"),
                 F.lit(0).cast("long").alias("both")),
    )
    return (cells.select(F.inline(sides)).groupBy("label")
            .agg(*[F.sum(F.col(c)).cast("double").alias(c) for c in ("in_a", "in_b", "both")]))


def _kappa():
    """Cohen's kappa from per-label counts."""
    n = F.sum("in_a")
    observed = F.sum("both") / n
    expected = F.sum(F.col("in_a") * F.col("in_b")) / (n * n)
    return F.try_divide(observed - expected, 1 - expected)


def classification_evaluate(df: DataFrame, y: str, pred: str,
                            metrics: Sequence[str] = CLASSIFICATION_METRICS) -> DataFrame:
    """(evaluate, value) rows of precision, recall and f1 of label 1, and Cohen's kappa.

    Predictions are rounded half to even first.
    """
    require_numeric(df, [y, pred])
    unknown = [m for m in metrics if m not in CLASSIFICATION_METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    pairs = df.select(quoted(y).cast("double").alias("_y"),
                      F.bround(quoted(pred).cast("double"), 0).alias("_p"))
    counts = _label_counts(pairs, "_y", "_p")

    def of_one(c: str):
        return F.coalesce(F.sum(F.when(F.col("label") == 1, F.col(c))), F.lit(0.0))

    one = counts.agg(of_one("both").alias("_tp"), of_one("in_b").alias("_pp"), of_one("in_a").alias("_ap"),
                     _kappa().alias("kappa"))
    zero = F.lit(0.0)
    one = one.withColumns({
        "precision": F.coalesce(F.try_divide("_tp", "_pp"), zero),
        "recall": F.coalesce(F.try_divide("_tp", "_ap"), zero),
        "f1": F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_pp") + F.col("_ap")), zero),
    })
    return _as_rows(one, metrics)


# Upper limits of the agreement bands.
AGREEMENT_BANDS = (
    (0.0, "none"), (0.20, "slight"), (0.40, "weak"), (0.60, "moderate"), (0.80, "strong"),
)


def consistency(df: DataFrame, y1: str, y2: str) -> DataFrame:
    """(score, band): kappa of two label columns rounded to 2 digits."""
    one = _label_counts(df, y1, y2).agg(F.round(_kappa(), 2).alias("score"))
    band = F.lit("almost perfect")
    for top, name in reversed(AGREEMENT_BANDS):
        band = F.when(F.col("score") <= top, name).otherwise(band)
    return one.withColumn("band", F.when(F.col("score").isNotNull(), band))
