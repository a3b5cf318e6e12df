"""Exact Gaussian likelihood of ARMA models for series of any length.

In state form the noise of a series is an affine function of its values and of the state
before the first one. A stretch of values is therefore summed up by a small matrix: the
products of its noise from a zero state, of the response to a constant, and of the responses
to each part of the state that comes in, with the state that goes out. Stretches compose in
order, so those of one series are worked on in parallel and joined afterwards; the unknown
first state is integrated out, and the mean follows in closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

EDGE = 8.0  # of the unbounded parameters: tanh(8) is 1 - 2e-7
ROUNDS = 60


def from_partial(partial: np.ndarray) -> np.ndarray:
    """AR coefficients from partial autocorrelations inside (-1, 1): always stationary."""
    phi = np.zeros(0)
    for r in partial:
        phi = np.append(phi - r * phi[::-1], r)
    return phi


@dataclass(frozen=True)
class Models:
    """ARMA models side by side: transition, noise weights and first covariance of each."""

    phi: np.ndarray  # (models, p)
    theta: np.ndarray  # (models, q)

    @staticmethod
    def at(points: np.ndarray, p: int) -> Models:
        """Stationary and invertible models from unbounded parameters, one row a model."""
        t = np.tanh(np.clip(np.atleast_2d(points), -EDGE, EDGE))
        return Models(np.array([from_partial(r[:p]) for r in t]).reshape(len(t), p),
                      np.array([-from_partial(r[p:]) for r in t]).reshape(len(t), t.shape[1] - p))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        k, p, q = len(self.phi), self.phi.shape[1], self.theta.shape[1]
        r = max(p, q + 1)
        t, w = np.zeros((k, r, r)), np.zeros((k, r))
        t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
        t[:, :p, 0] = self.phi
        w[:, 0], w[:, 1:q + 1] = 1.0, self.theta
        return t, w

    def covariance(self) -> np.ndarray:
        """Of the state before the first value, for unit noise."""
        t, w = self.parts()
        k, r = w.shape
        both = np.einsum("kij,kmn->kimjn", t, t).reshape(k, r * r, r * r)
        return np.linalg.solve(np.eye(r * r) - both, (w[:, :, None] * w[:, None, :]).reshape(k, r * r, 1)).reshape(k, r, r)


@dataclass
class Stretch:
    """Products of (noise, response to a constant, responses to the incoming state) over some values, and the outgoing state of each."""

    n: int
    gram: np.ndarray  # (models, r + 2, r + 2)
    out: np.ndarray  # (models, r, r + 2)

    def then(self, later: Stretch) -> Stretch:
        """Both, one after the other."""
        k, r = self.out.shape[:2]
        mix = np.zeros((k, r + 2, r + 2))
        mix[:, 0, 0] = mix[:, 1, 1] = 1.0
        mix[:, 2:, :] = self.out
        out = later.out[:, :, 2:] @ self.out
        out[:, :, :2] += later.out[:, :, :2]
        return Stretch(self.n + later.n, self.gram + np.swapaxes(mix, 1, 2) @ later.gram @ mix, out)

    def to_row(self) -> list[float]:
        return [float(self.n), *self.gram.ravel().tolist(), *self.out.ravel().tolist()]

    @staticmethod
    def from_row(row, models: int, r: int) -> Stretch:
        v = np.asarray(row, float)
        cut = 1 + models * (r + 2) ** 2
        return Stretch(int(v[0]), v[1:cut].reshape(models, r + 2, r + 2), v[cut:].reshape(models, r, r + 2))


def _equal_parts(models: Models, values: np.ndarray) -> list[Stretch]:
    """The stretches that the rows of ``values`` are, worked on side by side."""
    t, w = models.parts()
    (k, r), (m, size) = w.shape, values.shape
    a, c, h = np.zeros((k, m, r)), np.zeros((k, r)), np.tile(np.eye(r), (k, 1, 1))
    aa, ac, ah = np.zeros((k, m)), np.zeros((k, m)), np.zeros((k, m, r))
    rest = np.zeros((k, r + 1, r + 1))  # of the constant and the state: the same for every row
    first, turned = t[:, 0, :], np.swapaxes(t, 1, 2)
    for step in range(size):
        ea = values[:, step][None, :] - (a @ first[:, :, None])[:, :, 0]
        ec = 1.0 - (c * first).sum(axis=1)
        eh = -(first[:, None, :] @ h)[:, 0, :]
        a = a @ turned + ea[:, :, None] * w[:, None, :]
        c = (c[:, None, :] @ turned)[:, 0, :] + ec[:, None] * w
        h = t @ h + w[:, :, None] * eh[:, None, :]
        aa += ea * ea
        ac += ea * ec[:, None]
        ah += ea[:, :, None] * eh[:, None, :]
        e = np.concatenate([ec[:, None], eh], axis=1)
        rest += e[:, :, None] * e[:, None, :]
    out = []
    for j in range(m):
        gram = np.zeros((k, r + 2, r + 2))
        gram[:, 0, 0], gram[:, 0, 1], gram[:, 1, 0] = aa[:, j], ac[:, j], ac[:, j]
        gram[:, 0, 2:] = gram[:, 2:, 0] = ah[:, j]
        gram[:, 1:, 1:] = rest
        out.append(Stretch(size, gram, np.concatenate([a[:, j, :, None], c[:, :, None], h], axis=2)))
    return out


def summed(models: Models, values: np.ndarray) -> Stretch:
    """One stretch of values under each model."""
    size = max(1, math.isqrt(len(values)))
    full = len(values) // size
    parts = _equal_parts(models, values[:full * size].reshape(full, size))
    if full * size < len(values):
        parts += _equal_parts(models, values[full * size:][None, :])
    out = parts[0]
    for s in parts[1:]:
        out = out.then(s)
    return out


def concluded(models: Models, whole: Stretch, constant: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each model: -2 log-likelihood a value (less a constant), the mean, and the state after the last value."""
    p0 = models.covariance()
    r = p0.shape[1]
    b, c = whole.gram[:, 2:, :2], whole.gram[:, 2:, 2:]
    lhs = np.eye(r) + p0 @ c
    back = np.linalg.solve(lhs, p0 @ b)  # minus the first state that the values and the constant show
    s = whole.gram[:, :2, :2] - np.swapaxes(b, 1, 2) @ back
    with np.errstate(all="ignore"):
        mu = s[:, 0, 1] / s[:, 1, 1] if constant else np.zeros(len(p0))
        square = s[:, 0, 0] - 2 * mu * s[:, 0, 1] + mu * mu * s[:, 1, 1]
        sign, det = np.linalg.slogdet(lhs)
        loss = np.log(np.maximum(square, 1e-300) / whole.n) + det / whole.n
    loss = np.where((sign > 0) & np.isfinite(loss), loss, np.inf)
    weight = np.stack([np.ones_like(mu), -mu], axis=1)[:, :, None]
    state = whole.out[:, :, :2] @ weight - whole.out[:, :, 2:] @ (back @ weight)
    return loss, mu, state[:, :, 0]


def forecast(models: Models, mu: float, state: np.ndarray, steps: int) -> list[float]:
    """The next values of the first model."""
    t, out = models.parts()[0][0], []
    for _ in range(steps):
        state = t @ state
        out.append(float(mu + state[0]))
    return out


class Search:
    """Minimum over unbounded parameters by rounds: ``points`` asks, ``tell`` takes the values there.

    A coarse lattice comes first. Then a stencil around the best point gives slope and
    curvature, and Newton steps of several lengths are tried, in turns.
    """

    def __init__(self, dims: int, state: dict | None = None):
        s = state or {}
        self.dims, self.round, self.kind = dims, s.get("round", 0), s.get("kind", "lattice")
        self.best, self.loss, self.width, self.done = np.array(s.get("best", [0.0] * dims)), s.get("loss", math.inf), s.get("width", 0.05), s.get("done", dims == 0)
        self.tried = np.array(s["tried"]) if "tried" in s else self._lattice()

    def state(self) -> dict:
        return {"round": self.round, "kind": self.kind, "best": self.best.tolist(), "loss": self.loss, "width": self.width, "done": self.done, "tried": self.tried.tolist()}

    def _lattice(self) -> np.ndarray:
        if self.dims == 0:
            return np.zeros((1, 0))
        side = np.arctanh(np.array([-0.95, -0.6, -0.2, 0.2, 0.6, 0.95])) if self.dims < 4 else np.arctanh(np.array([-0.6, 0.2, 0.6]))
        return np.stack(np.meshgrid(*[side] * self.dims, indexing="ij"), axis=-1).reshape(-1, self.dims)

    def points(self) -> np.ndarray:
        return self.tried

    def _stencil(self) -> np.ndarray:
        e = np.eye(self.dims) * self.width
        pairs = [e[i] + e[j] for i in range(self.dims) for j in range(i)]
        self.best = np.clip(self.best, -EDGE + self.width, EDGE - self.width)
        return self.best + np.array([np.zeros(self.dims), *e, *-e, *pairs])

    def tell(self, loss: np.ndarray) -> None:
        self.round += 1
        d, k = self.dims, int(np.argmin(loss))
        if self.kind == "stencil" and np.isfinite(loss).all():
            up, down, h = loss[1:d + 1], loss[d + 1:2 * d + 1], self.width
            slope = (up - down) / (2 * h)
            curve = np.diag((up + down - 2 * loss[0]) / h**2)
            at = 2 * d + 1
            for i in range(d):
                for j in range(i):
                    curve[i, j] = curve[j, i] = (loss[at] - up[i] - up[j] + loss[0]) / h**2
                    at += 1
            values, vectors = np.linalg.eigh(curve)
            turned = vectors.T @ slope
            steps = [-(vectors @ (turned / np.maximum(np.abs(values), 1e-12) * part)) for part in (1.0, 0.5, 0.1, 0.01)]
            steps += [-(vectors @ (turned / (np.abs(values) + add))) for add in (0.01, 0.1, 1.0)]
            steps = [s * min(1.0, 2.0 / max(np.abs(s).max(), 1e-300)) for s in steps]
            self.loss, self.kind = float(loss[0]), "step"
            self.tried = np.clip(self.best + np.array([np.zeros(d), *steps]), -EDGE, EDGE)
            return
        moved = float(np.abs(self.tried[k] - self.best).max()) if d else 0.0
        gain = self.loss - float(loss[k])
        if self.kind == "step" and (moved < 1e-7 or gain < 1e-13):
            # Near the minimum smaller stencils see the slope better, until rounding hides it.
            self.done = self.width < 1e-3
            self.width /= 5
        elif self.kind == "step":
            self.width = min(0.05, max(2e-4, moved))
        self.best, self.loss, self.kind = self.tried[k].copy(), float(loss[k]), "stencil"
        self.done = self.done or self.round >= ROUNDS or not np.isfinite(self.loss)
        self.tried = self.best[None, :] if self.done else self._stencil()
