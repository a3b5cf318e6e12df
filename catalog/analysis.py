"""Correlations, components, weights, ranks and sensitivity."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from catalog.registry import query
from tablewright.core.gram import correlation_table
from tablewright.operators import analyze, decision, kendall, prep, regression as reg


def suppliers(t):
    """Per supplier: volume, mean discount and number of lines."""
    return t("lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum("l_quantity"), 2).alias("volume"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.count(F.lit(1)).cast("double").alias("lines"))


_SUP = """sup AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS volume, round(avg(l_discount), 6) AS discount, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1)"""
_COLS = ["volume", "discount", "lines"]


def _tau(a: str, b: str) -> str:
    s = f"sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})"
    return (f"sum({s})::DOUBLE / sqrt(sum((x.{a} <> y.{a})::INT)::DOUBLE * sum((x.{b} <> y.{b})::INT)::DOUBLE)")


_TAUS = ", ".join(f"{_tau(a, b)} AS t_{a}_{b}" for a, b in (("volume", "discount"), ("volume", "lines"), ("discount", "lines")))
_CRITIC = f"""
WITH {_SUP}, tau AS (SELECT {_TAUS} FROM sup x, sup y),
std AS (SELECT round(stddev_samp(volume), 3) v, round(stddev_samp(discount), 3) d, round(stddev_samp(lines), 3) l FROM sup),
c AS (SELECT 'volume' AS feature, v AS variability, round(2 - t_volume_discount - t_volume_lines, 3) AS conflict FROM tau, std
 UNION ALL SELECT 'discount', d, round(2 - t_volume_discount - t_discount_lines, 3) FROM tau, std
 UNION ALL SELECT 'lines', l, round(2 - t_volume_lines - t_discount_lines, 3) FROM tau, std),
w AS (SELECT *, variability * conflict AS information, variability * conflict / sum(variability * conflict) OVER () AS share FROM c)"""


@query("g03_correlation", """
SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN a || b IN ('l_quantityl_extendedprice', 'l_extendedpricel_quantity') THEN qe
 WHEN a || b IN ('l_quantityl_tax', 'l_taxl_quantity') THEN qt ELSE et END AS r
FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS a), (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS b),
 (SELECT round(corr(l_quantity, l_extendedprice), 6) qe, round(corr(l_quantity, l_tax), 6) qt, round(corr(l_extendedprice, l_tax), 6) et FROM lineitem)""")
def _(t):
    out = correlation_table(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return out.withColumn("r", F.round("r", 6))


@query("g04_kendall", f"""
WITH {_SUP}, tau AS (SELECT {_TAUS} FROM sup x, sup y)
SELECT 'volume' AS a, 'discount' AS b, round(t_volume_discount, 6) AS tau FROM tau UNION ALL SELECT 'volume', 'lines', round(t_volume_lines, 6) FROM tau
UNION ALL SELECT 'discount', 'lines', round(t_discount_lines, 6) FROM tau""")
def _(t):
    return kendall.kendall_pairs(suppliers(t), _COLS).withColumn("tau", F.round("tau", 6))


_Q = """(SELECT l_quantity, l_discount, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"""


@query("g04_kendall_lineitem", f"""
WITH g AS {_Q}, s AS (SELECT sum(x.w * y.w * sign(x.l_quantity - y.l_quantity) * sign(x.l_discount - y.l_discount)) AS c,
 sum(CASE WHEN x.l_quantity <> y.l_quantity THEN x.w * y.w END) AS p, sum(CASE WHEN x.l_discount <> y.l_discount THEN x.w * y.w END) AS q FROM g x, g y)
SELECT 'l_quantity' AS a, 'l_discount' AS b, round(c / sqrt(p * q), 6) AS tau FROM s""")
def _(t):
    # small blocks so that every part of the counting is used
    return kendall.kendall_pairs(t("lineitem"), ["l_quantity", "l_discount"], 20_000).withColumn("tau", F.round("tau", 6))


# two-sided: the share c lies within z standard errors, so 1 - (1 - c) / 2 lies below
_Z = ", ".join(f"({i / 20}, {NormalDist().inv_cdf(1 - (1 - i / 20) / 2)!r})" for i in range(1, 20))


@query("a01_confidence_limits", f"""
SELECT ci::DOUBLE AS ci, round(m + z * s / sqrt(n), 6) AS value FROM (VALUES {_Z}) v(ci, z),
(SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s, count(o_totalprice) n FROM orders)""")
def _(t):
    return analyze.ci_table(t("orders"), "o_totalprice").withColumn("value", F.round("value", 6))


def _three(source: str, a: str, b: str, c: str) -> str:
    """CTEs k (correlations), e (eigenvalues of the rounded ones) and v (leading eigenvector) of three columns."""
    return f"""
k AS (SELECT corr({a}, {b}) r12, corr({a}, {c}) r13, corr({b}, {c}) r23, count(*)::DOUBLE n FROM {source}),
t AS (SELECT *, round(r12, 3) q12, round(r13, 3) q13, round(r23, 3) q23 FROM k),
g AS (SELECT *, sqrt((q12 * q12 + q13 * q13 + q23 * q23) / 3) sq, sqrt((r12 * r12 + r13 * r13 + r23 * r23) / 3) sr FROM t),
e AS (SELECT i, 1 + 2 * sq * cos((acos(q12 * q13 * q23 / power(sq, 3)) - 2 * pi() * j) / 3) AS eig FROM g, (VALUES (1, 0), (2, 1), (3, 2)) o(i, j)),
l AS (SELECT *, 1 + 2 * sr * cos(acos(r12 * r13 * r23 / power(sr, 3)) / 3) AS lam FROM g),
w AS (SELECT lam, r12 * r23 - r13 * (1 - lam) AS x, r12 * r13 - r23 * (1 - lam) AS y, power(1 - lam, 2) - r12 * r12 AS z FROM l),
u AS (SELECT *, sqrt(x * x + y * y + z * z) * CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN sign(x) WHEN abs(y) >= abs(z) THEN sign(y) ELSE sign(z) END AS norm FROM w),
v AS (SELECT lam, unnest(['{a}', '{b}', '{c}']) AS feature, unnest([x / norm, y / norm, z / norm]) AS v FROM u)"""


def _tail(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom, by the midpoint rule."""
    return f"(SELECT sqrt(2 / pi()) * sum(exp(-power(sqrt({x}) + (i + 0.5) / 2000, 2) / 2)) / 2000 FROM range(20000) r(i))"


_EIG3 = f"WITH {_SUP}, {_three('sup', 'volume', 'discount', 'lines')}, rk AS (SELECT *, row_number() OVER (ORDER BY eig DESC) AS pos, sum(eig) OVER () AS s FROM e)"
_LINER3 = f"{_EIG3} SELECT feature, round(v, 4) AS component_1, round(round(v, 4), 4) AS score, round(round(v, 4) / sum(round(v, 4)) OVER () * 100, 2) AS weight_pct FROM v"

_R = f"{_SUP}, r AS (SELECT corr(volume, lines) AS r, count(*)::DOUBLE AS n FROM sup)"
_TWO = ["volume", "lines"]
_MANY = ["volume", "discount", "lines"]


def _pca(t, columns=_TWO):
    return analyze.pca_analyze(suppliers(t), columns)


@query("a02_pca_kmo", f"WITH {_R} SELECT 0.5::DOUBLE AS kmo, round(x, 1) AS bartlett_chi2, round({_tail('x')}, 3) AS bartlett_p FROM (SELECT -(n - 1 - 1.5) * ln(1 - r * r) AS x FROM r)")
def _(t):
    return _pca(t)["kmo"].withColumn("bartlett_chi2", F.round("bartlett_chi2", 1))


@query("a02_pca_variance", f"""
WITH {_R}, e AS (SELECT round(abs(r), 3) AS a FROM r)
SELECT round(1 + a, 6) AS eigenvalue, round((1 + a) / 2 * 100, 3) AS variance_pct, round((1 + a) / 2 * 100, 3) AS cumulative_pct, round(1 + a, 6) AS component_eigenvalue,
 round((1 + a) / 2 * 100, 3) AS component_variance_pct, round((1 + a) / 2 * 100, 3) AS component_cumulative_pct FROM e
UNION ALL SELECT round(1 - a, 6), round((1 - a) / 2 * 100, 3), 100.0, NULL, NULL, NULL FROM e""")
def _(t):
    out = _pca(t)["variance_table"]
    return out.select(*[F.round(c, 6 if "eigen" in c else 3).alias(c) for c in out.columns])


@query("a02_pca_loading", f"""
WITH {_R} SELECT f AS feature, round(sqrt((1 + r) / 2), 3) AS component_1, round((1 + r) / 2, 6) AS communality FROM r, (SELECT unnest(['volume', 'lines']) AS f)""")
def _(t):
    return _pca(t)["loading_table"].withColumn("communality", F.round("communality", 6))


@query("a02_pca_liner", """
SELECT f AS feature, 0.7071::DOUBLE AS component_1, 0.7071::DOUBLE AS score, 50.0::DOUBLE AS weight_pct FROM (SELECT DISTINCT unnest(['volume', 'lines']) AS f FROM lineitem)""")
def _(t):
    return _pca(t)["liner_table"].withColumn("score", F.round("score", 4))


@query("a02_pca_eigenvalue", f"WITH {_R} SELECT 1.0::DOUBLE AS x, round(1 + round(abs(r), 3), 3) AS y FROM r UNION ALL SELECT 2.0, round(1 - round(abs(r), 3), 3) FROM r")
def _(t):
    return _pca(t)["eigenvalue"]


@query("a02_pca_liner_many", _LINER3)
def _(t):
    return _pca(t, _MANY)["liner_table"].withColumn("score", F.round("score", 4))


@query("a03_factor_component", f"""
WITH {_R} SELECT f AS feature, round(sqrt((1 + r) / 2) / (1 + r), 3) AS component_1 FROM r, (SELECT unnest(['volume', 'lines']) AS f)""")
def _(t):
    return analyze.factor_analyze(suppliers(t), _TWO)["component_table"]


@query("a03_factor_variance", f"""{_EIG3}
SELECT round(eig, 6) AS eigenvalue, round(eig / s * 100, 3) AS variance_pct, round(sum(round(eig / s * 100, 3)) OVER (ORDER BY pos), 3) AS cumulative_pct,
 CASE WHEN pos = 1 THEN round(lam, 3) END AS unrotated_eigenvalue, CASE WHEN pos = 1 THEN round(lam / 3 * 100, 3) END AS unrotated_variance_pct,
 CASE WHEN pos = 1 THEN round(lam / 3 * 100, 3) END AS unrotated_cumulative_pct, CASE WHEN pos = 1 THEN round(lam, 3) END AS rotated_eigenvalue,
 CASE WHEN pos = 1 THEN round(lam / 3 * 100, 3) END AS rotated_variance_pct, CASE WHEN pos = 1 THEN round(lam / 3 * 100, 3) END AS rotated_cumulative_pct FROM rk, l""")
def _(t):
    out = analyze.factor_analyze(suppliers(t), _MANY)["variance_table"]
    return out.withColumns({"eigenvalue": F.round("eigenvalue", 6), "cumulative_pct": F.round("cumulative_pct", 3)})


@query("a03_factor_loading", f"{_EIG3} SELECT feature, round(v * sqrt(lam), 3) AS component_1, round(v * v * lam, 6) AS communality FROM v")
def _(t):
    return analyze.factor_analyze(suppliers(t), _MANY)["loading_table"].withColumn("communality", F.round("communality", 6))


@query("a03_factor_kmo", f"""{_EIG3},
p AS (SELECT *, power(r12 - r13 * r23, 2) / (1 - r13 * r13) / (1 - r23 * r23) + power(r13 - r12 * r23, 2) / (1 - r12 * r12) / (1 - r23 * r23)
 + power(r23 - r12 * r13, 2) / (1 - r12 * r12) / (1 - r13 * r13) AS q, r12 * r12 + r13 * r13 + r23 * r23 AS r FROM k)
SELECT round(kmo, 3) AS kmo, round(x, 1) AS bartlett_chi2, round({_tail('x')} + sqrt(2 * x / pi()) * exp(-x / 2), 3) AS bartlett_p
FROM (SELECT r / (r + q) AS kmo, -(n - 1 - 11 / 6.0) * ln(1 + 2 * r12 * r13 * r23 - r) AS x FROM p)""")
def _(t):
    return analyze.factor_analyze(suppliers(t), _MANY)["kmo"].withColumn("bartlett_chi2", F.round("bartlett_chi2", 1))


@query("a03_factor_liner", _LINER3)
def _(t):
    return analyze.factor_analyze(suppliers(t), _MANY)["liner_table"].withColumn("score", F.round("score", 4))


@query("a04_critic", f"{_CRITIC} SELECT feature, variability, conflict, round(information, 6) AS information, round(share * 100, 2) AS weight_pct FROM w")
def _(t):
    return decision.critic(suppliers(t), _COLS).withColumn("information", F.round("information", 6))


_TOPSIS = f"""{_CRITIC},
p AS (SELECT max(share) FILTER (feature = 'volume') AS wv, max(share) FILTER (feature = 'discount') AS wd, max(share) FILTER (feature = 'lines') AS wl FROM (SELECT feature, round(share, 5) AS share FROM w)),
u AS (SELECT l_suppkey, volume * wv AS a, discount * wd AS b, lines * wl AS c FROM sup, p),
g AS (SELECT l_suppkey, sqrt(power(a - max(a) OVER (), 2) + power(b - max(b) OVER (), 2) + power(c - max(c) OVER (), 2)) AS dp,
 sqrt(power(a - min(a) OVER (), 2) + power(b - min(b) OVER (), 2) + power(c - min(c) OVER (), 2)) AS dm FROM u),
m AS (SELECT l_suppkey, round(dp, 3) AS d_plus, round(dm, 3) AS d_minus, round(dm / (dp + dm), 3) AS closeness FROM g),
k AS (SELECT *, row_number() OVER (ORDER BY closeness DESC, l_suppkey) AS ranking FROM m)"""


@query("a05_topsis_matrix", f"{_TOPSIS} SELECT * FROM k")
def _(t):
    return decision.critic_topsis(suppliers(t), _COLS, "l_suppkey")["topsis_matrix"]


@query("a05_topsis_best", f"{_TOPSIS} SELECT * FROM k WHERE ranking = 1")
def _(t):
    return decision.critic_topsis(suppliers(t), _COLS, "l_suppkey")["best_result"]


@query("a05_topsis_ideals", f"""{_TOPSIS} SELECT 'volume' AS feature, round(max(a), 6) AS a_plus, round(min(a), 6) AS a_minus FROM u
UNION ALL SELECT 'discount', round(max(b), 6), round(min(b), 6) FROM u UNION ALL SELECT 'lines', round(max(c), 6), round(min(c), 6) FROM u""")
def _(t):
    out = decision.critic_topsis(suppliers(t), _COLS, "l_suppkey")["ideal_solutions"]
    return out.withColumns({c: F.round(c, 6) for c in ("a_plus", "a_minus")})


_W = {"p_size": 0.4, "p_retailprice": 0.6}
_GREY = """
WITH b AS (SELECT min(p_size) a, max(p_size) b, min(p_retailprice) c, max(p_retailprice) d FROM part),
k AS (SELECT p_partkey, 0.5 / (1 - (p_size::DOUBLE - a) / (b - a) + 0.5) AS x, 0.5 / (1 - (p_retailprice - c) / (d - c) + 0.5) AS y FROM part, b)"""


@query("a06_grey_ranking", f"""{_GREY} SELECT row_number() OVER (ORDER BY x * 0.4 + y * 0.6 DESC, p_partkey) AS ranking, p_partkey, round(x * 0.4 + y * 0.6, 3) AS degree FROM k""")
def _(t):
    return decision.grey_relation(t("part"), "p_partkey", _W)["grey_matrix_ranking"]


@query("a06_grey_score", f"{_GREY} SELECT round((avg(x) * 0.4 + avg(y) * 0.6) / 2, 6) AS score FROM k")
def _(t):
    return decision.grey_relation(t("part"), "p_partkey", _W)["score_matrix"].withColumn("score", F.round("score", 6))


@query("a07_sobol", """
WITH s AS (SELECT covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_discount, l_discount) c, covar_pop(l_quantity, l_extendedprice) p,
 covar_pop(l_discount, l_extendedprice) q, count(*)::DOUBLE n FROM lineitem),
w AS (SELECT ((c + 1 / n) * p - b * q) / ((a + 1 / n) * (c + 1 / n) - b * b) AS w0, ((a + 1 / n) * q - b * p) / ((a + 1 / n) * (c + 1 / n) - b * b) AS w1 FROM s),
v AS (SELECT power(w0 * (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 2) AS a, power(w1 * (SELECT max(l_discount) - min(l_discount) FROM lineitem), 2) AS b FROM w)
SELECT 'l_quantity' AS name, round(a / (a + b), 2) AS value FROM v UNION ALL SELECT 'l_discount', round(b / (a + b), 2) FROM v""")
def _(t):
    li = t("lineitem")
    model = reg.fit_ridge(li, ["l_quantity", "l_discount"], "l_extendedprice")
    bounds = prep.fit_min_max(li, ["l_quantity", "l_discount"])
    out = analyze.sobol(t.spark, model, bounds, n=16 * li.count())
    return out.withColumn("value", F.round("value", 2) + 0.0)


def _kpis(t):
    """Monthly volume per return flag as KPI arrays."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("m", "q"))), lambda s: s["q"])  # 12 values
    monthly = t("lineitem").groupBy("l_returnflag", F.month("l_shipdate").alias("m")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return monthly.groupBy(F.col("l_returnflag").alias("kpiName")).agg(cells.alias("value"))


_KPI = """kpi AS (SELECT month(l_shipdate) - 1 AS pos, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS n,
 round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS r FROM lineitem GROUP BY 1)"""
_KT = ", ".join(f"{_tau(a, b)} AS {a}{b}" for a, b in (("a", "n"), ("a", "r"), ("n", "r")))


@query("a08_kpi_critic_weights", f"""
WITH {_KPI}, tau AS (SELECT {_KT} FROM kpi x, kpi y), s AS (SELECT round(stddev_samp(a), 3) sa, round(stddev_samp(n), 3) sn, round(stddev_samp(r), 3) sr FROM kpi),
i AS (SELECT 'A' AS "kpiName", sa * round(2 - an - ar, 3) AS v FROM tau, s UNION ALL SELECT 'N', sn * round(2 - an - nr, 3) FROM tau, s UNION ALL SELECT 'R', sr * round(2 - ar - nr, 3) FROM tau, s)
SELECT "kpiName", round(v / sum(v) OVER () * 100, 2) AS value FROM i""")
def _(t):
    kpis = _kpis(t)
    weights = decision.critic(prep.kpi_rows(kpis, ["A", "N", "R"]), ["A", "N", "R"])
    return prep.kpi_weights(kpis, weights)


_KPI_LINER = f"""WITH {_KPI.replace(" a,", " av,").replace(" n,", " nv,").replace(" r FROM", " rv FROM")}, {_three('kpi', 'av', 'nv', 'rv')}
SELECT upper(feature[1]) AS "kpiName", round(round(v, 4) / sum(round(v, 4)) OVER () * 100, 2) AS value FROM v"""


@query("a08_kpi_pca_weights", _KPI_LINER)
def _(t):
    kpis = _kpis(t)
    weights = analyze.pca_analyze(prep.kpi_rows(kpis, ["A", "N", "R"]), ["A", "N", "R"])["liner_table"]
    return prep.kpi_weights(kpis, weights)


@query("a08_kpi_factor_weights", _KPI_LINER)
def _(t):
    kpis = _kpis(t)
    weights = analyze.factor_analyze(prep.kpi_rows(kpis, ["A", "N", "R"]), ["A", "N", "R"])["liner_table"]
    return prep.kpi_weights(kpis, weights)


@query("a08_kpi_topsis", f"{_TOPSIS} SELECT closeness AS result FROM k WHERE ranking = 1")
def _(t):
    return decision.kpi_score(suppliers(t), _COLS, "l_suppkey", "critic_topsis")


@query("a08_kpi_grey", f"""
WITH {_KPI}, b AS (SELECT min(a) la, max(a) ha, min(n) ln_, max(n) hn, min(r) lr, max(r) hr FROM kpi)
SELECT round((avg(0.5 / (1.5 - (a - la) / (ha - la))) * 0.5 + avg(0.5 / (1.5 - (n - ln_) / (hn - ln_))) * 0.3 + avg(0.5 / (1.5 - (r - lr) / (hr - lr))) * 0.2) / 3, 6) AS result FROM kpi, b""")
def _(t):
    rows = prep.kpi_rows(_kpis(t), ["A", "N", "R"])
    out = decision.kpi_score(rows, ["A", "N", "R"], "pos", "grey_relation", {"A": 0.5, "N": 0.3, "R": 0.2})
    return out.withColumn("result", F.round("result", 6))
