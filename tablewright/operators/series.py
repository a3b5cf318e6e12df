"""Time-series forecasts over any number of series: ARIMA and grey GM(1,N)."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.core.gram import moment_aggregates
from tablewright.core.layout import LAG_BLOCK, as_names, lagged, row_index, running_sum
from tablewright.core.session import stable
from tablewright.core.types import quoted, require_numeric
from tablewright.operators import arma

ARMA_BLOCK = 1 << 18  # values of a series that one task sums up at once


def _unpack(row: pd.Series, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and covariances from the moment columns of one series."""
    mean = np.array([row[f"_m{i}"] for i in range(k)], dtype=float)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[f"_c{i}_{j}"]
    return float(row["_n"]), mean, cov


def _least_squares(mean: np.ndarray, cov: np.ndarray, constant: bool) -> tuple[np.ndarray, float]:
    """Coefficients of column 0 on the others, and the intercept."""
    if constant:
        w = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0]
        return w, float(mean[0] - mean[1:] @ w)
    raw = cov + np.outer(mean, mean)
    return np.linalg.lstsq(raw[1:, 1:], raw[1:, 0], rcond=None)[0], 0.0


def _to_partial(phi: np.ndarray) -> np.ndarray:
    out, cur = [], phi.copy()
    while len(cur):
        r = float(np.clip(cur[-1], -0.98, 0.98))
        out.append(r)
        cur = (cur[:-1] + r * cur[:-1][::-1]) / (1 - r * r)
    return np.array(out[::-1])


def _start_covariance(phi: np.ndarray) -> np.ndarray:
    """Covariance of p consecutive values for unit noise, from the Yule-Walker equations."""
    p = len(phi)
    a, rhs = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
    rhs[0] = 1.0
    for i in range(p + 1):
        a[i, i] += 1.0
        for j in range(1, p + 1):
            a[i, abs(i - j)] -= phi[j - 1]
    g = np.linalg.solve(a, rhs)
    return np.array([[g[abs(i - j)] for j in range(p)] for i in range(p)])


def _minimise(f, x0: np.ndarray, step: np.ndarray, iters: int = 2000, tol: float = 1e-12) -> np.ndarray:
    """Nelder-Mead simplex search with one restart."""
    best = x0
    for _ in range(2):
        pts = [best] + [best + np.eye(len(best))[i] * step[i] for i in range(len(best))]
        val = [f(p) for p in pts]
        for _ in range(iters):
            order = np.argsort(val)
            pts, val = [pts[i] for i in order], [val[i] for i in order]
            if abs(val[-1] - val[0]) <= tol * (1 + abs(val[0])):
                break
            mid = np.mean(pts[:-1], axis=0)
            ref = mid + (mid - pts[-1])
            fr = f(ref)
            if fr < val[0]:
                ext = mid + 2 * (mid - pts[-1])
                fe = f(ext)
                pts[-1], val[-1] = (ext, fe) if fe < fr else (ref, fr)
            elif fr < val[-2]:
                pts[-1], val[-1] = ref, fr
            else:
                con = mid + 0.5 * ((ref if fr < val[-1] else pts[-1]) - mid)
                fc = f(con)
                if fc < min(fr, val[-1]):
                    pts[-1], val[-1] = con, fc
                else:
                    pts = [pts[0]] + [pts[0] + 0.5 * (q - pts[0]) for q in pts[1:]]
                    val = [val[0]] + [f(q) for q in pts[1:]]
        best = pts[int(np.argmin(val))]
        step = np.maximum(np.abs(step) * 0.05, 1e-6)
    return best


def _exact_ar(n: float, mean: np.ndarray, cov: np.ndarray, first: np.ndarray,
              constant: bool) -> tuple[np.ndarray, float]:
    """Exact Gaussian likelihood of an AR(p) from its moments and first p values.

    Returns coefficients and the process mean.
    """
    p = len(mean) - 1
    phi0, c0 = _least_squares(mean, cov, constant)
    partial0 = _to_partial(phi0)
    phi0 = arma.from_partial(partial0)
    mu0 = c0 / max(1 - phi0.sum(), 1e-3) if constant else 0.0

    def loss(v: np.ndarray) -> float:
        phi = arma.from_partial(np.tanh(v[:p]))
        mu = v[p] if constant else 0.0
        u = np.append(1.0, -phi)
        tail = n * (u @ cov @ u + (u @ mean - mu * (1 - phi.sum())) ** 2)
        try:
            start = _start_covariance(phi)
            sign, logdet = np.linalg.slogdet(start)
            head = (first - mu) @ np.linalg.solve(start, first - mu)
        except np.linalg.LinAlgError:
            return math.inf
        total = tail + head
        if sign <= 0 or total <= 0:
            return math.inf
        return (n + p) * math.log(total / (n + p)) + logdet

    x0 = np.append(np.arctanh(partial0), [mu0] if constant else [])
    scale = math.sqrt(max(cov[0, 0], 1e-12))
    step = np.append(np.full(p, 0.1), [0.1 * scale + 1e-6] if constant else [])
    best = _minimise(loss, x0, step)
    return arma.from_partial(np.tanh(best[:p])), float(best[p]) if constant else 0.0


def _advanced(search: arma.Search, p: int, whole: arma.Stretch, constant: bool) -> list[float] | None:
    """Take a round's sums; the mean and last state of the best model once the search is done."""
    models = arma.Models.at(search.points(), p)
    loss, mu, state = arma.concluded(models, whole, constant)
    if search.done:
        return [float(mu[0]), *state[0].tolist()]
    search.tell(loss)
    return None


def _arma_fits(work: DataFrame, keys: list[str], p: int, q: int, constant: bool, block: int) -> DataFrame:
    """(keys, _fit): the model of greatest exact likelihood for each series of ``work`` (keys, _i, _w), as text.

    Values lie in blocks of ``block``, one row each. A series of one block is fitted where it
    lies; the blocks of the others are summed up in parallel, round by round of the same search,
    and the sums compose in order, 256 at a time.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in work.select(*keys).schema.fields]
    values = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_w"))), lambda s: s["_w"])
    home = F.floor((F.col("_i") - F.col("_i_min")) / block).cast("long")
    blocks = stable(work.groupBy(*keys, home.alias("_block"), (F.col("_last") - F.col("_i_min") >= block).alias("_long")).agg(values.alias("_values")))

    def fitted(search: arma.Search, final: list[float]) -> str:
        return json.dumps({"point": search.best.tolist(), "mu": final[0], "state": final[1:]})

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row, v in zip(pdf[keys].itertuples(index=False), pdf["_values"], strict=True):
                search, final, w = arma.Search(p + q), None, np.asarray(v, float)
                while final is None:
                    final = _advanced(search, p, arma.summed(arma.Models.at(search.points(), p), w), constant)
                out.append([*row, fitted(search, final)])
            yield pd.DataFrame(out, columns=[*keys, "_fit"])

    fits = blocks.where("not _long").select(*keys, "_values").mapInPandas(alone, ", ".join([*fields, "_fit string"]))
    long = blocks.where("_long")
    state = stable(long.where("_block = 0").select(*keys, F.lit(json.dumps(arma.Search(p + q).state())).alias("_state"), F.lit(None).cast("string").alias("_fit")))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [arma.summed(arma.Models.at(arma.Search(p + q, json.loads(s)).points(), p), np.asarray(v, float)).to_row()
                    for s, v in zip(pdf["_state"], pdf["_values"], strict=True)]
            yield pdf[[*keys, "_block", "_state"]].assign(_sums=made)

    def composed(pdf: pd.DataFrame) -> arma.Stretch:
        search, r = arma.Search(p + q, json.loads(pdf["_state"].iloc[0])), max(p, q + 1)
        parts = [arma.Stretch.from_row(v, len(search.points()), r) for v in pdf.sort_values("_block")["_sums"]]
        return functools.reduce(arma.Stretch.then, parts)

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values("_block").head(1)[[*keys, "_block", "_state"]].assign(_sums=[composed(pdf).to_row()])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        search = arma.Search(p + q, json.loads(pdf["_state"].iloc[0]))
        final = _advanced(search, p, composed(pdf), constant)
        return pdf.head(1)[keys].assign(_state=json.dumps(search.state()), _fit=fitted(search, final) if final else None)

    summary = ", ".join([*fields, "_block long", "_state string", "_sums array<double>"])
    done: list[DataFrame] = []
    while not state.isEmpty():
        got = _join_keys(long.drop("_long"), state.select(*keys, "_state"), keys).mapInPandas(sums, summary)
        got = got.groupBy(*keys, F.floor(F.col("_block") / 256).alias("_of")).applyInPandas(lambda pdf: some(pdf), summary)
        state = stable(got.groupBy(*keys).applyInPandas(told, ", ".join([*fields, "_state string", "_fit string"])))
        done.append(state.where("_fit is not null").select(*keys, "_fit"))
        state = state.where("_fit is null")
    return functools.reduce(DataFrame.unionByName, done, fits)


def _tails(rows: DataFrame, keys: list[str], value: str, count: int, name: str,
           newest: bool = True) -> DataFrame:
    """The last (or first) ``count`` values per series, oldest first; at most ``count`` rows each."""
    at = (F.col("_n_all") - F.col("_i")) < count if newest else F.col("_i") <= F.col("_i_min") + count - 1
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))),
                          lambda s: s["v"])
    picked = rows.where(at)
    out = picked.groupBy(*keys).agg(ordered.alias(name)) if keys else picked.agg(ordered.alias(name))
    return out


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    if not keys:
        return left.join(F.broadcast(right), how="cross")  # one-row tables
    named = right.select(*[quoted(c).alias(f"_k_{c}") if c in keys else quoted(c) for c in right.columns])
    cond = [quoted(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, cond, how).drop(*[f"_k_{k}" for k in keys])


def arima_forecast(df: DataFrame, y: str, order_by, p: int, d: int, q: int, steps: int, by=None,
                   limit: int = LAG_BLOCK, block: int = ARMA_BLOCK) -> DataFrame:
    """Forecast ``steps`` values of each series with an ARIMA(p, d, q): (by..., step, y).

    The coefficients maximise the exact Gaussian likelihood. Without a moving-average part that
    needs only lag moments and the first p values; with one, the noise of blocks of ``block``
    values is summed up and composed (see ``arma``), which gives the same for every length
    and every block. No series has any part in the forecast of another.
    Undifferenced models have a mean, differenced ones have none.
    """
    keys = as_names(by)
    require_numeric(df, [y])
    if min(p, d, q) < 0 or p + d + q == 0 and steps < 1:
        raise ValueError("orders must not be negative")
    constant = d == 0
    src = df.select(*keys, *(order_by if isinstance(order_by, list) else [order_by]),
                    quoted(y).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    rows = row_index(src, order_by, by=by, name="_i")
    rows = stable(rows.select(*keys, "_i", "_y"))  # read several times below
    centre = F.avg("_y") if constant else F.lit(0.0)
    size = (rows.groupBy(*keys) if keys else rows).agg(F.max("_i").alias("_n_all"), centre.alias("_centre"))
    rows = _join_keys(rows, size, keys)
    # d-th difference as a weighted sum of the value and its d lags
    work = lagged(rows, ["_y"], d, "_i", by, limit) if d else rows
    diff = sum((F.col(f"_y_lag{k}") * float((-1) ** k * math.comb(d, k)) for k in range(1, d + 1)), F.col("_y"))
    work = work.withColumn("_w", diff).where(F.col("_i") > d).select(*keys, "_i", "_n_all", "_centre", "_w")
    work = work.withColumn("_i_min", F.lit(d + 1))
    if q:
        # Around the mean, where there is one: better conditioned.
        centred = work.select(*(keys or [F.lit(0).alias("_one")]), "_i", "_i_min", F.col("_n_all").alias("_last"), (F.col("_w") - F.col("_centre")).alias("_w"))
        model = _arma_fits(centred, keys or ["_one"], p, q, constant, block)
        model = _join_keys(model if keys else model.drop("_one"), size, keys)
        parts = [_tails(rows, keys, "_y", max(d, 1), "_tail_y")]
    else:
        wide = lagged(work, ["_w"], p, "_i", by, limit) if p else work
        full = wide.where(F.col("_i") > d + p)
        aggs = moment_aggregates(["_w", *[f"_w_lag{k}" for k in range(1, p + 1)]])
        model = full.groupBy(*keys).agg(*aggs) if keys else full.agg(*aggs)
        parts = [_tails(work, keys, "_w", max(p, 1), "_tail_w"), _tails(work, keys, "_w", max(p, 1), "_head_w", newest=False),
                 _tails(rows, keys, "_y", max(d, 1), "_tail_y")]
    for part in parts:
        model = _join_keys(model, part, keys)
    key_schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields] if keys else []
    schema = ", ".join([*key_schema, "step int", f"`{y}` double"])

    def ahead(row: pd.Series) -> list[float]:
        """The next values of the differenced series."""
        if q:
            fit = json.loads(row["_fit"])
            return [v + float(row["_centre"]) for v in arma.forecast(arma.Models.at(np.array(fit["point"]), p), fit["mu"], np.array(fit["state"]), steps)]
        n, mean, cov = _unpack(row, 1 + p)
        phi, mu = np.zeros(0), mean[0] if constant else 0.0
        if p:
            phi, mu = _exact_ar(n, mean, cov, np.array(row["_head_w"], dtype=float), constant)
        w = list(row["_tail_w"])
        for _ in range(steps):
            w.append(mu + sum(phi[k] * (w[-1 - k] - mu) for k in range(p)))
        return w[len(w) - steps:]

    def forecast(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for _, row in pdf.iterrows():  # one row per series
                level = [float(v) for v in row["_tail_y"]]
                for s, value in enumerate(ahead(row), 1):
                    if d:
                        value -= sum((-1) ** k * math.comb(d, k) * level[-k] for k in range(1, d + 1))
                        level.append(value)
                    out.append([*[row[k] for k in keys], s, float(value)])
            yield pd.DataFrame(out, columns=[*keys, "step", y])

    return model.mapInPandas(forecast, schema)


def gm1n(train: DataFrame, future: DataFrame, x: Sequence[str], y: str, order_by: str, by=None,
         limit: int = LAG_BLOCK) -> DataFrame:
    """Grey GM(1,N) forecast of the future rows: (by..., order_by, x..., gm1n_pre).

    Accumulated series are running sums; the background value of a row is its
    accumulated y less half of y. Parameters come from the normal equations of
    each series and the response is an expression of row number and sums.
    """
    keys, x = as_names(by), list(x)
    require_numeric(train, [*x, y])
    require_numeric(future, x)
    cols = [*[quoted(k) for k in keys], quoted(order_by)]
    vals = [quoted(c).cast("double").alias(c) for c in x]
    known = train.select(*cols, *vals, quoted(y).cast("double").alias("_y"), F.lit(0).alias("_later"))
    ahead = future.select(*cols, *vals, F.lit(0.0).alias("_y"), F.lit(1).alias("_later"))
    rows = row_index(known.unionByName(ahead), ["_later", order_by], by=by, name="_i")
    sums = {"_y1": "_y", **{f"_x1_{j}": c for j, c in enumerate(x)}}
    rows = stable(running_sum(rows, sums, "_i", by=by))  # read for the fit and the response
    b = [-(F.col("_y1") - F.col("_y") / 2), *[F.col(f"_x1_{j}") for j in range(len(x))]]
    k = len(b)
    use = (F.col("_later") == 0) & (F.col("_i") > 1)
    aggs = [F.max(F.when(F.col("_i") == 1, F.col("_y"))).alias("_base")]
    aggs += [F.sum(F.when(use, b[i] * b[j])).alias(f"_b{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(F.when(use, b[i] * F.col("_y"))).alias(f"_r{i}") for i in range(k)]
    stats = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    key_schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in train.select(*keys).schema.fields] if keys else []
    schema = ", ".join([*key_schema, "_base double", "_alpha double", "_beta array<double>"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for _, row in pdf.iterrows():  # one row per series
                a = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = row[f"_b{i}_{j}"]
                v = np.linalg.pinv(a) @ np.array([row[f"_r{i}"] for i in range(k)], dtype=float)
                out.append([*[row[c] for c in keys], row["_base"], float(v[0]), v[1:].tolist()])
            yield pd.DataFrame(out, columns=[*keys, "_base", "_alpha", "_beta"])

    fitted = _join_keys(rows, stats.mapInPandas(solve, schema), keys)
    u = sum((F.col("_beta")[j] * F.col(f"_x1_{j}") for j in range(len(x))), F.lit(0.0)) / F.col("_alpha")
    response = (F.col("_base") - u) / F.exp(F.col("_alpha") * F.col("_i")) + u
    fitted = lagged(fitted.withColumn("_f", response), ["_f"], 1, "_i", by, limit)
    step = F.round(F.col("_f") - F.coalesce(F.col("_f_lag1"), F.lit(0.0)), 3)
    return fitted.where("_later = 1").select(*cols, *[quoted(c) for c in x], step.alias("gm1n_pre"))
