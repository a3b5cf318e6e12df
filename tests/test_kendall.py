from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablewright.operators.kendall import discordant, kendall_matrix, kendall_pairs


def tau_b(a, b):
    c = d = ta = tb = 0
    n = len(a)
    for i in range(n):
        for j in range(i):
            s = np.sign(a[i] - a[j]) * np.sign(b[i] - b[j])
            c += s > 0
            d += s < 0
            ta += a[i] != a[j]
            tb += b[i] != b[j]
    return (c - d) / np.sqrt(float(ta) * float(tb)) if ta and tb else None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 3)), min_size=1, max_size=30))
def test_discordant_matches_enumeration(rows):
    a, b, w = (np.array(v) for v in zip(*rows))
    want = sum(w[i] * w[j] for i in range(len(a)) for j in range(len(a)) if a[i] < a[j] and b[i] > b[j])
    assert discordant(a, b, w) == want


def frame(spark, seed, n=240):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.35, 3.0, np.round(rng.normal(size=n), 1))  # a third share one value
    b = np.round(a * 0.5 + rng.normal(size=n), 1)
    c = rng.integers(0, 4, n).astype(float)
    return np.column_stack([a, b, c]), spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([a, b, c])],
                                                             "a double, b double, c double")


@pytest.mark.parametrize("block_rows", [10_000, 40, 7])
def test_matrix_matches_enumeration(spark, block_rows):
    x, df = frame(spark, block_rows)
    got = kendall_matrix(df, ["a", "b", "c"], block_rows)
    for i in range(3):
        for j in range(i):
            assert got[i, j] == pytest.approx(tau_b(x[:, i], x[:, j]), abs=1e-12)


def test_missing_values_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 1.0, 5.0), (None, 4.0, 5.0), (4.0, 0.0, 5.0)],
                               "a double, b double, c double")
    got = {(r.a, r.b): r.tau for r in kendall_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == -1.0
    assert got[("a", "c")] is None
    assert kendall_matrix(df, ["a", "b", "c"])[0, 2] == 0.0
