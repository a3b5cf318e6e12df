"""Linear regressions fitted from distributed moments or one aggregate per step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tablewright.core.gram import Moments, grouped_moments, moments
from tablewright.core.layout import as_names, row_index
from tablewright.core.numeric import elastic_net
from tablewright.core.session import hold
from tablewright.core.types import quoted, require_numeric
from tablewright.operators.models import LinearModel, MultiLinearModel
from tablewright.operators.prep import hash_unit


def _linear(m: Moments, x: Sequence[str], y: str, w: np.ndarray) -> LinearModel:
    b = float(m.mean_of([y])[0] - m.mean_of(x) @ w)
    return LinearModel(tuple(x), tuple(float(v) for v in w), b)


def _ridge_weights(m: Moments, x: Sequence[str], y: str, alpha: float) -> np.ndarray:
    a = m.pick(x, x) + alpha * np.eye(len(x))
    rhs = m.pick(x, [y])[:, 0]
    try:
        return np.linalg.solve(a, rhs)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, rhs, rcond=None)[0]


def fit_ridge(df: DataFrame, x: Sequence[str], y: str, alpha: float = 1.0) -> LinearModel:
    """Minimise |y - b - Xw|^2 + alpha |w|^2 in one pass."""
    m = moments(df, [*x, y])
    return _linear(m, x, y, _ridge_weights(m, x, y, alpha))


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_numeric(df, columns)
    return df.dropna(subset=list(columns))


def with_folds(df: DataFrame, folds: int, order_by=None, name: str = "_fold") -> DataFrame:
    """Fold number per row: equal runs of ``order_by``, or the hash of the row."""
    if order_by is None:
        return df.withColumn(name, hash_unit(df.columns, 0, folds).cast("int"))
    n = df.count()
    ranked = row_index(df, order_by, name="_at")
    big, at = n % folds, F.col("_at") - 1
    size = n // folds
    # the first n % folds runs hold one row more
    cut = big * (size + 1)
    fold = F.when(at < cut, F.floor(at / (size + 1))).otherwise(
        F.lit(big) + F.floor((at - cut) / max(size, 1)))
    return ranked.withColumn(name, fold.cast("int")).drop("_at")


def _cross_validated(df: DataFrame, x: list[str], y: str, l1_ratio: float, n_alphas: int,
                     max_iter: int, folds: int, order_by, eps: float = 1e-3,
                     tol: float = 1e-4) -> tuple[LinearModel, float]:
    order = [c for c in as_names(order_by) if c not in (*x, y)]
    # Only what the fit and the folds need is read; rows are told apart by these values.
    ready = with_folds(_complete(df, [*x, y]).select(*[quoted(c) for c in dict.fromkeys([*x, y, *order])]), folds, order_by)
    parts = [p for p in grouped_moments(ready, [*x, y], "_fold", folds).values() if p.n > 0]
    if len(parts) < 2:
        raise ValueError("not enough rows to cross-validate")

    def pooled(items: list[Moments]) -> Moments:
        out = items[0]
        for p in items[1:]:
            out = out.merge(p)
        return out

    def grid(m: Moments) -> np.ndarray:
        top = np.abs(m.pick(x, [y])[:, 0]).max() / (m.n * l1_ratio)
        top = max(top, np.finfo(float).resolution)
        return np.geomspace(top, top * eps, n_alphas)

    def path(m: Moments, alphas: np.ndarray) -> list[np.ndarray]:
        out, w = [], np.zeros(len(x))
        for a in alphas:
            w = elastic_net(m.pick(x, x), m.pick(x, [y])[:, 0], m.n, a, l1_ratio, max_iter, tol, w)
            out.append(w.copy())
        return out

    whole = pooled(parts)
    alphas = grid(whole)
    errors = np.zeros(n_alphas)
    for i, held in enumerate(parts):
        train = pooled(parts[:i] + parts[i + 1:])
        sxx, sxy = held.pick(x, x), held.pick(x, [y])[:, 0]
        syy = held.pick([y], [y])[0, 0]
        for k, w in enumerate(path(train, alphas)):
            # mean squared error on the held-out rows, from their moments alone
            shift = (held.mean_of([y])[0] - train.mean_of([y])[0]) - \
                (held.mean_of(x) - train.mean_of(x)) @ w
            errors[k] += (syy - 2 * w @ sxy + w @ sxx @ w) / held.n + shift**2
    best = float(alphas[int(np.argmin(errors))])
    w = elastic_net(whole.pick(x, x), whole.pick(x, [y])[:, 0], whole.n, best, l1_ratio, max_iter, tol)
    return _linear(whole, x, y, w), best


def _ridge_loo(df: DataFrame, x: list[str], y: str, alphas: Sequence[float]) -> tuple[LinearModel, float]:
    """Ridge with the strength of least leave-one-out error: one pass for moments, one for errors."""
    m = moments(df, [*x, y])
    mean = m.mean_of(x)
    rows = _complete(df, [*x, y])
    centred = [quoted(c).cast("double") - F.lit(float(mean[i])) for i, c in enumerate(x)]
    aggs, models = [], []
    for alpha in alphas:
        model = _linear(m, x, y, _ridge_weights(m, x, y, alpha))
        inv = np.linalg.inv(m.pick(x, x) + alpha * np.eye(len(x)))
        hat = F.lit(1.0 / m.n)
        for i in range(len(x)):
            for j in range(i, len(x)):
                scale = float(inv[i, j] * (1 if i == j else 2))
                hat = hat + centred[i] * centred[j] * F.lit(scale)
        err = (quoted(y).cast("double") - model.expression()) / (F.lit(1.0) - hat)
        aggs.append(F.avg(err * err))
        models.append(model)
    scores = np.array(rows.agg(*aggs).first(), dtype=float)
    best = int(np.argmin(scores))
    return models[best], float(alphas[best])


def fit_linear(df: DataFrame, x: Sequence[str], y: str, penalty: str = "l1", n_alphas: int = 100,
               max_iter: int = 1000, folds: int = 5, order_by=None) -> LinearModel:
    """Cross-validated linear regression.

    ``l1`` is the lasso, ``l2`` ridge over strengths 0.1, 1 and 10 by
    leave-one-out error, anything else the elastic net with equal parts.
    Folds follow ``order_by`` in equal runs; without it they are row hashes.
    """
    x = list(x)
    if penalty == "l2":
        return _ridge_loo(df, x, y, (0.1, 1.0, 10.0))[0]
    ratio = 1.0 if penalty == "l1" else 0.5
    return _cross_validated(df, x, y, ratio, int(n_alphas), int(max_iter), folds, order_by)[0]


def fit_pls(df: DataFrame, x: Sequence[str], y: str | Sequence[str], n_components: int = 2,
            scale: bool = True, max_iter: int = 500, tol: float = 1e-6) -> MultiLinearModel:
    """Partial least squares from moments only: X and Y deflate through their cross-products."""
    x, ys = list(x), [y] if isinstance(y, str) else list(y)
    m = moments(df, [*x, *ys])
    sx = np.sqrt(np.diag(m.pick(x, x)) / (m.n - 1)) if scale else np.ones(len(x))
    sy = np.sqrt(np.diag(m.pick(ys, ys)) / (m.n - 1)) if scale else np.ones(len(ys))
    sx, sy = np.where(sx == 0, 1.0, sx), np.where(sy == 0, 1.0, sy)
    xx = m.pick(x, x) / np.outer(sx, sx)
    xy = m.pick(x, ys) / np.outer(sx, sy)
    weights, x_load, y_load = [], [], []
    for _ in range(min(n_components, len(x))):
        # first left singular direction of X'Y by power iteration
        w = xy[:, np.argmax((xy**2).sum(axis=0))].copy()
        if not np.any(np.abs(w) > 1e-300):
            break
        for _ in range(max_iter):
            w /= np.linalg.norm(w)
            new = xy @ (xy.T @ w)
            new /= np.linalg.norm(new)
            if np.sum((new - w) ** 2) < tol or len(ys) == 1:
                w = new
                break
            w = new
        tt = float(w @ xx @ w)
        if tt <= 0:
            break
        p, q = xx @ w / tt, xy.T @ w / tt
        weights.append(w)
        x_load.append(p)
        y_load.append(q)
        xy = xy - np.outer(p, q) * tt
        xx = xx - np.outer(p, p) * tt
    if not weights:
        coef = np.zeros((len(ys), len(x)))
    else:
        wm, pm, qm = np.column_stack(weights), np.column_stack(x_load), np.column_stack(y_load)
        rotation = wm @ np.linalg.pinv(pm.T @ wm)
        coef = (rotation @ qm.T).T * sy[:, None] / sx[None, :]
    b = m.mean_of(ys) - coef @ m.mean_of(x)
    rows = tuple(tuple(float(v) for v in r) for r in coef)
    return MultiLinearModel(tuple(x), tuple(ys), rows, tuple(float(v) for v in b))


def fit_svr(df: DataFrame, x: Sequence[str], y: str, C: float = 1.0, epsilon: float = 0.1,
            max_iter: int = -1, tol: float = 1e-3) -> LinearModel:
    """Linear support vector regression in the primal.

    Minimises |w|^2 / 2 + C * sum(max(0, |y - xw - b| - epsilon)). The corner of
    the loss is smoothed over a width that shrinks to nothing; every Newton step
    is one aggregate over the rows. Features are standardised while solving.
    """
    x = list(x)
    m = moments(df, [*x, y])
    p = len(x)
    sd = np.where(m.std()[:p] > 0, m.std()[:p], 1.0)
    mx, my = m.mean_of(x), float(m.mean_of([y])[0])
    spread = float(m.std()[-1]) or 1.0
    cols = [((quoted(c).cast("double") - F.lit(float(mx[i]))) / F.lit(float(sd[i]))).alias(f"z{i}")
            for i, c in enumerate(x)]
    rows = hold(_complete(df, [*x, y]).select(*cols, (quoted(y).cast("double") - F.lit(my)).alias("t")))
    z = [F.col(f"z{i}") for i in range(p)] + [F.lit(1.0)]
    penalty = np.append(1.0 / sd**2, 0.0)
    spark = df.sparkSession
    scales = [2.0**-k for k in range(12)]

    def attached(**params: Sequence[float]):
        # Parameters arrive as a one-row table, so every step runs the same compiled plan.
        names = [f"{k}{i}" for k, vals in params.items() for i in range(len(vals))]
        row = [float(x) for vals in params.values() for x in vals]
        now = spark.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names))
        return rows.join(F.broadcast(now), how="cross")

    def dot(name: str):
        return sum((z[i] * F.col(f"{name}{i}") for i in range(p + 1)), F.lit(0.0))

    def loss(r, width):
        over = F.greatest(F.abs(r) - F.lit(epsilon), F.lit(0.0))
        return F.when(over < width, over * over / (2 * width)).otherwise(over - width / 2)

    def newton(at: np.ndarray, width: float):
        """Objective, gradient and curvature at a point: one pass."""
        w = F.col("w0")
        staged = attached(v=at, w=[width]).withColumn("r", F.col("t") - dot("v"))
        over = F.greatest(F.abs("r") - F.lit(epsilon), F.lit(0.0))
        slope = F.signum("r") * F.least(over / w, F.lit(1.0))
        curve = F.when((over > 0) & (over < w), 1.0 / w).otherwise(0.0)
        staged = staged.select(*rows.columns, loss(F.col("r"), w).alias("l"), slope.alias("g"), curve.alias("h"))
        aggs = [F.sum("l")] + [F.sum(F.col("g") * z[i]) for i in range(p + 1)]
        aggs += [F.sum(F.col("h") * z[i] * z[j]) for i in range(p + 1) for j in range(i, p + 1)]
        got = np.array(staged.agg(*aggs).first(), dtype=float)
        hess = np.zeros((p + 1, p + 1))
        hess[np.triu_indices(p + 1)] = got[p + 2:]
        hess = hess + np.triu(hess, 1).T
        value = 0.5 * float(penalty @ at**2) + C * got[0]
        return value, penalty * at - C * got[1:p + 2], np.diag(penalty) + C * hess

    def along(at: np.ndarray, move: np.ndarray, width: float) -> np.ndarray:
        """Objective at every step length: one pass."""
        staged = attached(v=at, m=move, w=[width]).select(
            (F.col("t") - dot("v")).alias("r"), dot("m").alias("d"), "w0")
        sums = staged.agg(*[F.sum(loss(F.col("r") - F.col("d") * k, F.col("w0"))) for k in scales]).first()
        fixed = [0.5 * float(penalty @ (at + k * move) ** 2) for k in scales]
        return np.array(fixed) + C * np.array(sums, dtype=float)

    try:
        v = np.append(_ridge_weights(m, x, y, 1e-8 * m.n) * sd, 0.0)
        width, steps = spread, 0
        limit = max_iter if max_iter and max_iter > 0 else 500
        while steps < limit:
            value, grad, hess = newton(v, width)
            steps += 1
            ridge = 1e-10 * np.trace(hess) * np.eye(p + 1)
            move = np.linalg.lstsq(hess + ridge, -grad, rcond=None)[0]
            if -float(grad @ move) > 0.01 * tol * abs(value):
                trials = along(v, move, width)
                best = int(np.argmin(trials))
                if trials[best] < value - 1e-3 * tol * abs(value):
                    v = v + scales[best] * move
                    continue
            # the smoothed loss is below the true one by at most this much
            if C * m.n * width / 2 <= 0.3 * tol * max(abs(value), 1e-12):
                break
            width /= 4
    finally:
        rows.unpersist()
    w = v[:p] / sd
    b = my + v[p] - float(mx @ w)
    return LinearModel(tuple(x), tuple(float(c) for c in w), float(b))
