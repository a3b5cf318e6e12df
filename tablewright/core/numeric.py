"""Small scalar and p-by-p numerics used on the driver after an aggregate."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else beta_cdf(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2))


def f_ppf(q: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection on a doubling bracket."""
    lo, hi = 0.0, 1.0
    while f_cdf(hi, d1, d2) < q:
        hi *= 2.0
        if hi > 1e12:
            return hi
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if f_cdf(mid, d1, d2) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    s, z = df / 2.0, x / 2.0
    log_front = s * math.log(z) - z - math.lgamma(s)
    if z < s + 1.0:
        term = total = 1.0 / s
        for k in range(1, 10_000):
            term *= z / (s + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(log_front))
    tiny = 1e-300
    b = z + 1.0 - s
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for k in range(1, 10_000):
        num = -k * (k - s)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h * math.exp(log_front)


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Flip columns so that the entry of largest magnitude is positive."""
    out = vectors.copy()
    for j in range(out.shape[1]):
        if out[np.argmax(np.abs(out[:, j])), j] < 0:
            out[:, j] = -out[:, j]
    return out


def varimax(loadings: np.ndarray, tol: float = 1e-5, max_iter: int = 500) -> np.ndarray:
    """Varimax rotation with Kaiser row normalisation."""
    p, k = loadings.shape
    if k < 2:
        return loadings
    norms = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    a = loadings / norms
    rot, last = np.eye(k), 0.0
    for _ in range(max_iter):
        b = a @ rot
        grad = a.T @ (b**3 - b @ np.diag((b**2).sum(axis=0)) / p)
        u, s, vt = np.linalg.svd(grad)
        rot = u @ vt
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    return (a @ rot) * norms


def elastic_net(gram: np.ndarray, xty: np.ndarray, n: float, alpha: float, l1_ratio: float,
                max_iter: int, tol: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on centred moments for

    ``|y - Xw|^2 / (2n) + alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) * |w|_2^2 / 2``.
    """
    p = len(xty)
    w = np.zeros(p) if start is None else start.copy()
    l1, l2 = alpha * l1_ratio * n, alpha * (1.0 - l1_ratio) * n
    for _ in range(max_iter):
        biggest, step = 0.0, 0.0
        for j in range(p):
            if gram[j, j] == 0.0:
                continue
            rho = xty[j] - gram[j] @ w + gram[j, j] * w[j]
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / (gram[j, j] + l2)
            step = max(step, abs(new - w[j]))
            biggest = max(biggest, abs(new))
            w[j] = new
        if step <= tol * biggest or biggest == 0.0:
            break
    return w
