"""Model fits, forecasts, model use and evaluation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from catalog.io import scratch
from catalog.registry import query
from catalog import tree_sql as ts
from tablewright.operators import (
    analogy as ana, curvefit, custom, evaluate, models, regression as reg, series, trees,
)

X2, Y = ["l_quantity", "l_discount"], "l_extendedprice"


def _line(t, model, names=("intercept", "w0", "w1"), digits=4):
    vals = [model.intercept, *model.coef][: len(names)]
    return t.spark.createDataFrame([tuple(round(float(v), digits) for v in vals)], ", ".join(f"{n} double" for n in names))


_RIDGE = """
s AS (SELECT count(*) n, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my, covar_pop(l_quantity, l_quantity) * count(*) a,
 covar_pop(l_quantity, l_discount) * count(*) b, covar_pop(l_discount, l_discount) * count(*) c, covar_pop(l_quantity, l_extendedprice) * count(*) p,
 covar_pop(l_discount, l_extendedprice) * count(*) q FROM lineitem),
w AS (SELECT *, ((c + 1) * p - b * q) / ((a + 1) * (c + 1) - b * b) AS w0, ((a + 1) * q - b * p) / ((a + 1) * (c + 1) - b * b) AS w1 FROM s)"""


@query("m02_ridge", f"WITH {_RIDGE} SELECT round(my - w0 * m1 - w1 * m2, 4) AS intercept, round(w0, 4) AS w0, round(w1, 4) AS w1 FROM w")
def _(t):
    return _line(t, reg.fit_ridge(t("lineitem"), X2, Y, alpha=1.0))


@query("m01_linear_l2", """
WITH m AS (SELECT count(*) n, avg(l_quantity) mx, avg(l_extendedprice) my, covar_pop(l_quantity, l_quantity) * count(*) sxx,
 covar_pop(l_quantity, l_extendedprice) * count(*) sxy FROM lineitem),
a AS (SELECT *, sxy / (sxx + alpha) AS w FROM m, (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS alpha)),
e AS (SELECT alpha, any_value(w) w, any_value(my - w * mx) AS b, avg(power((l_extendedprice - my - w * (l_quantity - mx)) /
 (1 - 1.0 / n - (l_quantity - mx) * (l_quantity - mx) / (sxx + alpha)), 2)) AS loo FROM a, lineitem GROUP BY 1)
SELECT round(b, 4) AS intercept, round(w, 4) AS w0 FROM e ORDER BY loo LIMIT 1""")
def _(t):
    return _line(t, reg.fit_linear(t("lineitem"), ["l_quantity"], Y, "l2"), ("intercept", "w0"))


def _cv_sql(ratio: float) -> str:
    # one feature: the coefficient is a soft threshold; folds are equal runs of the key
    return f"""
WITH n AS (SELECT count(*) n FROM part),
r AS (SELECT p_size::DOUBLE x, p_retailprice y, row_number() OVER (ORDER BY p_partkey) - 1 AS i, n FROM part, n),
f AS (SELECT x, y, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM r),
full_ AS (SELECT count(*) n, avg(x) mx, avg(y) my, covar_pop(x, x) * count(*) sxx, covar_pop(x, y) * count(*) sxy FROM f),
g AS (SELECT abs(sxy) / n / {ratio} * power(1e-3, k / 19.0) AS alpha FROM full_, range(20) t(k)),
tr AS (SELECT h.fold, count(*) n, avg(x) mx, avg(y) my, covar_pop(x, x) * count(*) sxx, covar_pop(x, y) * count(*) sxy
 FROM (SELECT DISTINCT fold FROM f) h JOIN f ON f.fold <> h.fold GROUP BY 1),
w AS (SELECT fold, alpha, mx, my, sign(sxy) * greatest(abs(sxy) - n * alpha * {ratio}, 0) / (sxx + n * alpha * {1 - ratio}) AS w FROM tr, g),
e AS (SELECT alpha, sum(mse) s FROM (SELECT alpha, w.fold, avg(power(y - my - w * (x - mx), 2)) mse FROM w JOIN f ON f.fold = w.fold GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT alpha FROM e ORDER BY s, alpha DESC LIMIT 1),
o AS (SELECT mx, my, sign(sxy) * greatest(abs(sxy) - n * alpha * {ratio}, 0) / (sxx + n * alpha * {1 - ratio}) AS w FROM full_, b)
SELECT round(my - w * mx, 4) AS intercept, round(w, 4) AS w0 FROM o"""


@query("m01_linear_l1", _cv_sql(1.0))
def _(t):
    model = reg.fit_linear(t("part"), ["p_size"], "p_retailprice", "l1", n_alphas=20, order_by=["p_partkey"])
    return _line(t, model, ("intercept", "w0"))


@query("m01_linear_elastic", _cv_sql(0.5))
def _(t):
    model = reg.fit_linear(t("part"), ["p_size"], "p_retailprice", "l1l2", n_alphas=20, order_by=["p_partkey"])
    return _line(t, model, ("intercept", "w0"))


@query("m01_linear_hash_folds")
def _(t):
    model = reg.fit_linear(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], Y, "l1", n_alphas=50)
    return _line(t, model, ("intercept", "w0", "w1", "w2"))


@query("m03_pls", """
WITH s AS (SELECT avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my, stddev_samp(l_quantity) s1, stddev_samp(l_discount) s2,
 stddev_samp(l_extendedprice) sy, corr(l_quantity, l_discount) r12, corr(l_quantity, l_extendedprice) r1, corr(l_discount, l_extendedprice) r2 FROM lineitem),
w AS (SELECT *, r1 / sqrt(r1 * r1 + r2 * r2) w1, r2 / sqrt(r1 * r1 + r2 * r2) w2 FROM s),
q AS (SELECT *, (w1 * r1 + w2 * r2) / (w1 * w1 + w2 * w2 + 2 * w1 * w2 * r12) AS q FROM w),
c AS (SELECT *, w1 * q * sy / s1 AS c1, w2 * q * sy / s2 AS c2 FROM q)
SELECT round(my - c1 * m1 - c2 * m2, 4) AS intercept, round(c1, 4) AS w0, round(c2, 4) AS w1 FROM c""")
def _(t):
    m = reg.fit_pls(t("lineitem"), X2, Y, n_components=1)
    return _line(t, models.LinearModel(m.features, m.coef[0], m.intercept[0]))


@query("m04_svr")
def _(t):
    model = reg.fit_svr(t("lineitem"), X2, Y, C=1.0, epsilon=0.1)
    return _line(t, model, digits=2)


# Without a margin the best intercept for a slope is a median, and the objective is convex in the slope.
@query("m04_svr_objective", """
WITH d AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part),
a AS (SELECT w, median(y - w * x) AS b FROM d, (SELECT s / 10.0 AS w FROM range(-500, 501) r(s)) GROUP BY 1),
f AS (SELECT w, 0.5 * w * w + sum(abs(y - w * x - b)) AS f FROM d, a GROUP BY 1),
g AS (SELECT arg_min(w, f) AS w0 FROM f),
a1 AS (SELECT w, median(y - w * x) AS b FROM d, (SELECT w0 + s / 1000.0 AS w FROM g, range(-150, 151) r(s)) GROUP BY 1),
f1 AS (SELECT w, 0.5 * w * w + sum(abs(y - w * x - b)) AS f FROM d, a1 GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS n, round(min(f) / (SELECT count(*) FROM d), 1) AS objective FROM f1""")
def _(t):
    src = t("part").selectExpr("double(p_size) x", "p_retailprice y")
    model = reg.fit_svr(src, ["x"], "y", C=1.0, epsilon=0.0, tol=1e-4)
    return model.predict(src, "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("y") - F.col("p"))).alias("lost")).select(
        "n", F.round((F.col("lost") + 0.5 * float(model.coef[0]) ** 2) / F.col("n"), 1).alias("objective"))


def _scores(t, model, y=Y):
    done = model.predict(t("lineitem", "l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    return evaluate.regression_evaluate(done, y, "prediction", ["r2", "rmse"]).withColumn("value", F.round("value", 3))


X3 = ["l_quantity", "l_discount", "l_tax"]
_XS = "l_quantity AS x0, l_discount AS x1, l_tax AS x2"
_CELLS = f"c AS MATERIALIZED (SELECT {_XS}, count(*)::DOUBLE AS n, sum(l_extendedprice) AS a, count(*)::DOUBLE AS b, sum(l_extendedprice * l_extendedprice) AS q FROM lineitem GROUP BY ALL)"


def _with(tables: list[str], rest: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + rest


def _cell_scores(prediction: str) -> str:
    """r2 and rmse from cells (n, a, q) and their prediction."""
    return f"""SELECT unnest(['r2', 'rmse']) AS evaluate, round(unnest([1 - e / v, sqrt(e / n)]), 3) AS value FROM (
 SELECT sum(n) AS n, sum(q) - sum(a) * sum(a) / sum(n) AS v, sum(q - 2 * p * a + n * p * p) AS e FROM ({prediction}))"""


_DEPTH4 = _with([_CELLS, *ts.tree("t", "c", 3, 4, ts.SQUARED)], _cell_scores("SELECT n, a, q, value AS p FROM t JOIN t_v USING (leaf)"))
_FIVE = _with([_CELLS, *ts.tree("t", "c", 3, 4, ts.SQUARED, leaves=5, least=100)],
              "SELECT round(value, 2) AS prediction, sum(n)::BIGINT AS n FROM t JOIN t_v USING (leaf) GROUP BY 1")


@query("m05_tree_five_leaves", _FIVE)
def _(t):
    model = trees.fit_decision_tree(t("lineitem"), X3, Y, None, min_samples_leaf=100, max_leaf_nodes=5)
    return model.predict(t("lineitem", *X3)).groupBy(F.round("prediction", 2).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


_POISSON = _with([_CELLS, *ts.tree("t", "c", 3, 3, "{a} * ln({a} / {n})", leaves=4, least=100, valid="al > 0 AND ar > 0")],
                 "SELECT round(value, 2) AS prediction, sum(n)::BIGINT AS n FROM t JOIN t_v USING (leaf) GROUP BY 1")


@query("m05_tree_poisson", _POISSON)
def _(t):
    model = trees.fit_decision_tree(t("lineitem"), X3, Y, None, min_samples_leaf=100, max_leaf_nodes=4, criterion="poisson")
    return model.predict(t("lineitem", *X3)).groupBy(F.round("prediction", 2).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


# Quantities with a few far outliers: the absolute error and the squared error cut differently.
_FAR = "CASE WHEN l_discount = 0.03 AND l_linenumber = 1 THEN l_quantity * 100 ELSE l_quantity END"


def _median_level(d: int) -> str:
    return f"""h{d} AS MATERIALIZED (SELECT node, f, v, side, y FROM (SELECT node, y, unnest([0, 1]) AS f, unnest([x0, x1]) AS x FROM m{d}) r JOIN (
  SELECT DISTINCT node, f, v FROM (SELECT node, unnest([0, 1]) AS f, unnest([x0, x1]) AS v FROM m{d}) QUALIFY v < max(v) OVER (PARTITION BY node, f)) c USING (node, f), (SELECT unnest([0, 1, 2]) AS side)
  WHERE side = 2 OR (x <= v)::INT = side),
e{d} AS MATERIALIZED (SELECT node, f, v, side, sum(abs(y - m)) AS away FROM (SELECT *, median(y) OVER (PARTITION BY node, f, v, side) AS m FROM h{d}) GROUP BY ALL),
k{d} AS MATERIALIZED (SELECT node, f, v FROM (SELECT node, f, v, round(sum(CASE side WHEN 2 THEN away ELSE -away END), 9) AS gain FROM e{d} GROUP BY ALL) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
m{d + 1} AS MATERIALIZED (SELECT m.* REPLACE (CASE WHEN k.node IS NULL THEN -abs(m.node) WHEN [x0, x1][f + 1] <= v THEN 2 * m.node ELSE 2 * m.node + 1 END AS node) FROM m{d} m LEFT JOIN k{d} k USING (node))"""


@query("m05_tree_absolute_error", f"""WITH m0 AS MATERIALIZED (SELECT l_discount AS x0, l_tax AS x1, ({_FAR})::DOUBLE AS y, 1 AS node FROM lineitem), {_median_level(0)}, {_median_level(1)}
SELECT x0 AS l_discount, x1 AS l_tax, p AS prediction, count(*) AS n FROM (SELECT *, median(y) OVER (PARTITION BY node) AS p FROM m2) GROUP BY ALL""")
def _(t):
    li = t("lineitem").withColumn("far", F.expr(f"cast({_FAR} as double)"))
    model = trees.fit_decision_tree(li, X3[1:], "far", 2, criterion="absolute_error")
    return model.predict(t("lineitem", *X3[1:])).groupBy(*X3[1:], "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m05_decision_tree", _DEPTH4)
def _(t):
    return _scores(t, trees.fit_decision_tree(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], Y, max_depth=4))


# Two leaves on one column with few values: the best cut leaves the least squared error.
_STUMP = """
g AS (SELECT l_discount AS x, count(*) n, sum({y}) s FROM lineitem GROUP BY 1),
c AS (SELECT x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS na, sum(s) OVER () AS sa FROM g WINDOW w AS (ORDER BY x)),
b AS (SELECT * FROM c WHERE nl < na ORDER BY sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) DESC LIMIT 1)"""
_STUMP_Y = _STUMP.format(y="l_extendedprice")
_STUMP_SQL = f"WITH {_STUMP_Y} SELECT l_discount, round(CASE WHEN l_discount <= x THEN sl / nl ELSE (sa - sl) / (na - nl) END, 2) AS prediction, count(*) AS n FROM lineitem, b GROUP BY 1, 2"


def _by_discount(t, model, digits=2):
    done = model.predict(t("lineitem", "l_discount"))
    return done.groupBy("l_discount", F.round("prediction", digits).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("m05_tree_one_cut", _STUMP_SQL)
def _(t):
    return _by_discount(t, trees.fit_decision_tree(t("lineitem"), ["l_discount"], Y, max_depth=1))


@query("m06_forest_one_cut", _STUMP_SQL)
def _(t):
    return _by_discount(t, trees.fit_random_forest(t("lineitem"), ["l_discount"], Y, 1, 1, bootstrap=False, max_features="all"))


@query("m07_boosted_one_cut", _STUMP_SQL)
def _(t):
    # at rate 1 the first tree takes the mean all the way to its leaves' means
    return _by_discount(t, trees.fit_boosted(t("lineitem"), ["l_discount"], Y, num_leaves=2, num_boost_round=1, learning_rate=1.0))


@query("m07_binary_one_cut", f"""WITH {_STUMP.format(y="(l_linestatus = 'O')::INT")}
SELECT l_discount, (CASE WHEN l_discount <= x THEN sl / nl ELSE (sa - sl) / (na - nl) END > 0.5)::INT::DOUBLE AS prediction, count(*) AS n FROM lineitem, b GROUP BY 1, 2""")
def _(t):
    li = t("lineitem").withColumn("late", (F.col("l_linestatus") == "O").cast("double"))
    return _by_discount(t, trees.fit_boosted(li, ["l_discount"], "late", "binary", num_leaves=2, num_boost_round=1, learning_rate=1.0))


_POISSON_COUNT = "CASE " + " ".join(f"WHEN u <= {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r} THEN {k}" for k in range(11)) + " ELSE 11 END"
_FOREST = [f"k AS MATERIALIZED (SELECT {_XS}, l_extendedprice AS y, {ts.row_number('l_orderkey || chr(58) || l_linenumber', 3)} AS r FROM lineitem)"]
for _i in range(4):
    _FOREST.append(f"f{_i} AS MATERIALIZED (SELECT x0, x1, x2, sum(w)::DOUBLE AS n, sum(w * y) AS a, sum(w)::DOUBLE AS b FROM (SELECT *, {_POISSON_COUNT} AS w FROM (SELECT *, {ts.uniform('r', _i)} AS u FROM k)) GROUP BY ALL)")
    _FOREST += ts.tree(f"t{_i}", f"f{_i}", 3, 3, ts.SQUARED, least=50)
_FOREST_SQL = _with(_FOREST, "SELECT x0 AS l_quantity, x1 AS l_discount, x2 AS l_tax, round((" + " + ".join(f"v{_i}.value" for _i in range(4)) + ") / 4, 2) AS prediction FROM t0 "
                    + " ".join(f"JOIN t{_i} USING (x0, x1, x2)" for _i in range(1, 4)) + " " + " ".join(f"JOIN t{_i}_v v{_i} ON v{_i}.leaf = t{_i}.leaf" for _i in range(4)))


@query("m06_forest_of_samples", _FOREST_SQL)
def _(t):
    model = trees.fit_random_forest(t("lineitem"), X3, Y, 4, 3, min_samples_leaf=50, max_features="all", random_state=3, key=["l_orderkey", "l_linenumber"])
    return model.predict(t("lineitem", *X3).distinct()).withColumn("prediction", F.round("prediction", 2))


@query("m06_random_forest")
def _(t):
    return _scores(t, trees.fit_random_forest(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], Y, 8, 4))


_BOOST, _LAST = ts.boosted("c", 3, 5, 8, 0.1, "n * s{k} - a", "n", ["(SELECT sum(a) / sum(n) FROM c)"])


@query("m07_boosted_regression", _with([_CELLS, *_BOOST], _cell_scores(f"SELECT n, a, q, s0 AS p FROM {_LAST}")))
def _(t):
    return _scores(t, trees.fit_boosted(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], Y, num_leaves=8, num_boost_round=5))


_LATE = f"c AS MATERIALIZED (SELECT {_XS}, count(*)::DOUBLE AS n, sum((l_linestatus = 'O')::INT)::DOUBLE AS a FROM lineitem GROUP BY ALL)"
_BOOST2, _LAST2 = ts.boosted("c", 3, 3, 4, 0.1, "n / (1 + exp(-s{k})) - a", "n / (1 + exp(-s{k})) * (1 - 1 / (1 + exp(-s{k})))", ["(SELECT ln(sum(a) / (sum(n) - sum(a))) FROM c)"])


@query("m07_boosted_binary", _with([_LATE, *_BOOST2], f"""
, z AS (SELECT sum(n) AS n, sum(n) FILTER (s0 > 0) AS b, sum(a) AS a, coalesce(sum(a) FILTER (s0 > 0), 0) AS tp, coalesce(sum(n - a) FILTER (s0 <= 0), 0) AS tn FROM {_LAST2}),
y AS (SELECT *, (tp + tn) / n AS po, (a * coalesce(b, 0) + (n - a) * (n - coalesce(b, 0))) / n / n AS pe FROM z)
SELECT unnest(['precision', 'recall', 'f1', 'kappa']) AS evaluate, round(unnest([tp / b, tp / a, 2 * tp / (a + coalesce(b, 0)), (po - pe) / (1 - pe)]), 3) AS value FROM y"""))
def _(t):
    li = t("lineitem").withColumn("late", (F.col("l_linestatus") == "O").cast("double"))
    model = trees.fit_boosted(li, ["l_quantity", "l_discount", "l_tax"], "late", "binary", num_leaves=4, num_boost_round=3)
    return evaluate.classification_evaluate(model.predict(li), "late", "prediction").withColumn("value", F.round("value", 3))


_FLAGS = f"c AS MATERIALIZED (SELECT {_XS}, count(*)::DOUBLE AS n, " + ", ".join(f"sum((l_returnflag = '{v}')::INT)::DOUBLE AS a{k}" for k, v in enumerate("ANR")) + " FROM lineitem GROUP BY ALL)"
_SOFT = "(exp(s{k}) / (exp(s0) + exp(s1) + exp(s2)))"
_BOOST3, _LAST3 = ts.boosted("c", 3, 2, 4, 0.3, f"n * {_SOFT} - a{{k}}", f"n * {_SOFT} * (1 - {_SOFT}) * 1.5", [f"(SELECT ln(sum(a{k}) / sum(n)) FROM c)" for k in range(3)])


@query("m07_boosted_flags", _with([_FLAGS, *_BOOST3], f"SELECT x0 AS l_quantity, x1 AS l_discount, x2 AS l_tax, CASE greatest(s0, s1, s2) WHEN s0 THEN 0.0 WHEN s1 THEN 1.0 ELSE 2.0 END AS prediction FROM {_LAST3}"))
def _(t):
    li = t("lineitem").withColumn("flag", F.instr(F.lit("ANR"), F.col("l_returnflag")).cast("double") - 1)
    model = trees.fit_boosted(li, X3, "flag", "multiclass", num_leaves=4, num_boost_round=2, learning_rate=0.3)
    return model.predict(t("lineitem", *X3).distinct())


def _goss_sql() -> str:
    """Two rounds over quantities: the fifth with the largest gradients, and a tenth of all rows from the others at eight times their weight."""
    out = [f"k AS MATERIALIZED (SELECT l_discount AS x0, l_tax AS x1, ({_FAR})::DOUBLE AS y, {ts.row_number('l_orderkey || chr(58) || l_linenumber', 0)} AS r, avg(({_FAR})::DOUBLE) OVER () AS s FROM lineitem)"]
    for i in range(2):
        now = "k" if i == 0 else f"k{i}"
        out.append(f"q{i} AS MATERIALIZED (SELECT quantile_disc(abs(s - y), 0.8) AS high FROM {now})")
        out.append(f"w{i} AS MATERIALIZED (SELECT x0, x1, count(*) FILTER (w > 0)::DOUBLE AS n, sum(w * (s - y)) AS a, sum(w) AS b FROM (SELECT *, CASE WHEN abs(s - y) >= high THEN 1.0 WHEN {ts.uniform('r', i)} < 0.125 THEN 8.0 ELSE 0.0 END AS w FROM {now}, q{i}) GROUP BY ALL)")
        out += ts.tree(f"t{i}", f"w{i}", 2, 3, ts.NEWTON, leaves=4, least=20, value="-sum(a) / sum(b)", valid="bl >= 1e-3 AND br >= 1e-3")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT {now}.* REPLACE (s + 0.5 * value AS s) FROM {now} JOIN t{i} USING (x0, x1) JOIN t{i}_v USING (leaf))")
    return _with(out, "SELECT x0 AS l_discount, x1 AS l_tax, round(any_value(s), 3) AS prediction FROM k2 GROUP BY ALL")


@query("m07_goss", _goss_sql())
def _(t):
    li = t("lineitem").withColumn("far", F.expr(f"cast({_FAR} as double)"))
    model = trees.fit_boosted(li, X3[1:], "far", boosting_type="goss", num_leaves=4, num_boost_round=2, learning_rate=0.5, key=["l_orderkey", "l_linenumber"])
    return model.predict(t("lineitem", *X3[1:]).distinct()).withColumn("prediction", F.round("prediction", 3))


# The second round leaves the first tree out and grows it again: each of the two then weighs half the rate.
_DART, _ = ts.boosted("c", 3, 1, 4, 0.5, "n * s{k} - a", "n", ["(SELECT sum(a) / sum(n) FROM c)"])


@query("m07_dart", _with([_CELLS, *_DART], "SELECT x0 AS l_quantity, x1 AS l_discount, x2 AS l_tax, round(s0, 2) AS prediction FROM r1"))
def _(t):
    model = trees.fit_boosted(t("lineitem"), X3, Y, boosting_type="dart", num_leaves=4, num_boost_round=2, learning_rate=0.5, skip_drop=0.0, drop_rate=1.0)
    return model.predict(t("lineitem", *X3).distinct()).withColumn("prediction", F.round("prediction", 2))


@query("m07_boosted_multiclass")
def _(t):
    e = t("embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
                               (F.col("label") % 3).cast("double").alias("label"))
    model = trees.fit_boosted(e, [f"e{i}" for i in range(64)], "label", "multiclass", num_leaves=4, num_boost_round=2)
    return model.predict(e).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m07_forest_classifier", """
SELECT l_discount, (l_discount > 0.05)::INT::DOUBLE AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    # the feature decides the label, so every tree finds the same cut
    li = t("lineitem").withColumn("high", (F.col("l_discount") > 0.05).cast("double"))
    return _by_discount(t, trees.fit_boosted(li, ["l_discount"], "high", "binary", "rf", num_leaves=4, num_boost_round=9))


@query("m08_k_means", "SELECT vec_id, 1 AS own_rank, 10 AS clusters FROM embeddings")
def _(t):
    # at the optimum every row is nearest to the mean of its own cluster, and no cluster is empty
    dims = [f"e{i}" for i in range(64)]
    e = t("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    out = trees.k_means(e, dims, 10, seed=1, max_iter=300)
    centres = out.groupBy(F.col("cluster").alias("k")).agg(F.array(*[F.avg(d) for d in dims]).alias("c"))  # ten rows
    near = out.select("vec_id", "cluster", F.array(*dims).alias("v")).crossJoin(F.broadcast(centres))
    gap = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    gaps = near.select("vec_id", (F.col("cluster") == F.col("k")).alias("own"), gap.alias("gap")).groupBy("vec_id").agg(
        F.max(F.when(F.col("own"), F.col("gap"))).alias("own"), F.collect_list("gap").alias("gaps"))
    return gaps.select("vec_id", (1 + F.size(F.filter("gaps", lambda g: g < F.col("own") - 1e-9))).alias("own_rank"), F.size("gaps").alias("clusters"))


# A decaying response built from the lines: exponential in quantity, disturbed by the tax.
_DECAY = "5 * exp(-0.1 * l_quantity) + 2 + (l_tax - 0.04)"
_NEWTON_EXP = f"""
d AS (SELECT l_returnflag, l_quantity AS x, count(*) AS n, sum({_DECAY}) AS sy FROM lineitem GROUP BY 1, 2),
it(l_returnflag, k, b, best) AS (
 SELECT DISTINCT l_returnflag, 0, 0.05::DOUBLE, 0.15::DOUBLE FROM d UNION ALL
 SELECT l_returnflag, k + 1, arg_max(t, gain) - (any_value(best) - any_value(b)) / 10, arg_max(t, gain) + (any_value(best) - any_value(b)) / 10 FROM (
  SELECT l_returnflag, k, b, best, t, power(sum(sy * e) - sum(n * e) * sum(sy) / sum(n), 2) / (sum(n * e * e) - sum(n * e) * sum(n * e) / sum(n)) AS gain FROM (
   SELECT d.*, it.k, it.b, it.best, it.b + (it.best - it.b) * s / 20 AS t, exp(-(it.b + (it.best - it.b) * s / 20) * x) AS e
   FROM it JOIN d USING (l_returnflag), range(21) r(s) WHERE it.k < 12) GROUP BY ALL) GROUP BY l_returnflag, k),
f AS (SELECT l_returnflag, (b + best) / 2 AS b FROM it WHERE k = 12),
p AS (SELECT l_returnflag, any_value(b) AS b, (sum(sy * exp(-b * x)) - sum(n * exp(-b * x)) * sum(sy) / sum(n)) /
 (sum(n * exp(-2 * b * x)) - power(sum(n * exp(-b * x)), 2) / sum(n)) AS a, sum(sy) / sum(n) AS my, sum(n * exp(-b * x)) / sum(n) AS me
 FROM f JOIN d USING (l_returnflag) GROUP BY 1)"""


def _decay(t):
    return t("lineitem").withColumn("resp", F.expr(_DECAY))


@query("m11_exponential_by_group", f"""
WITH RECURSIVE {_NEWTON_EXP}
SELECT l_returnflag, round(a, 3) AS a, round(b, 4) AS b, round(my - a * me, 3) AS c FROM p""")
def _(t):
    out = curvefit.fit_exponential(_decay(t), "l_quantity", "resp", (4.0, 0.2, 1.0), by="l_returnflag")
    return out.select("l_returnflag", F.round("a", 3).alias("a"), F.round("b", 4).alias("b"), F.round("c", 3).alias("c"))


@query("m11_exponential", f"""
WITH RECURSIVE {_NEWTON_EXP.replace("l_returnflag, l_quantity AS x", "'all' AS l_returnflag, l_quantity AS x").replace("GROUP BY 1, 2)", "GROUP BY 2)")}
SELECT round(a, 3) AS a, round(b, 4) AS b, round(my - a * me, 3) AS c FROM p""")
def _(t):
    out = curvefit.fit_exponential(_decay(t), "l_quantity", "resp", (4.0, 0.2, 1.0))
    return out.select(*[F.round(c, d).alias(c) for c, d in (("a", 3), ("b", 4), ("c", 3))])


@query("m12_logfit_by_group", """
SELECT l_returnflag, round(regr_intercept(l_extendedprice, log10(l_quantity)), 4) AS a, round(regr_slope(l_extendedprice, log10(l_quantity)), 4) AS b,
count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    out = curvefit.fit_logarithm(t("lineitem"), "l_quantity", Y, by="l_returnflag")
    return out.select("l_returnflag", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "n")


def daily(t):
    """One series per event type: daily totals."""
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


_DAILY = "daily AS (SELECT event_type, ts::DATE AS day, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1, 2)"


def _weibull_sql(series: str, m: float, a: float) -> str:
    """Damped Gauss-Newton steps over (g, t, y, k) rows; table ``it`` holds step s."""
    return f"""{series},
it(g, s, m, a) AS (
 SELECT DISTINCT g, 0, {m}::DOUBLE, {a}::DOUBLE FROM d UNION ALL
 SELECT g, s + 1, m + 0.5 * (hb * ga - hab * gb) / (ha * hb - hab * hab), a + 0.5 * (ha * gb - hab * ga) / (ha * hb - hab * hab) FROM (
  SELECT g, s, m, a, sum(jm * jm) ha, sum(jm * ja) hab, sum(ja * ja) hb, sum(jm * r) ga, sum(ja * r) gb FROM (
   SELECT *, y - f AS r, f * (1 / m + ln(t) - a * power(t, m) * ln(t)) AS jm, f * (1 / a - power(t, m)) AS ja FROM (
    SELECT it.g, s, m, a, t, y, k * m * a * power(t, m - 1) * exp(-a * power(t, m)) AS f FROM it JOIN d ON it.g = d.g WHERE s < 120)) GROUP BY ALL))"""


_PER_TYPE = _weibull_sql(_DAILY + """, d AS (SELECT event_type AS g, total AS y, row_number() OVER (PARTITION BY event_type ORDER BY day)::DOUBLE AS t,
 sum(total) OVER (PARTITION BY event_type) AS k FROM daily)""", 1.5, 0.02)


@query("m13_weibull", f"WITH RECURSIVE {_PER_TYPE} SELECT g AS event_type, 1 AS peak, round(m, 4) AS m, round(a, 5) AS a FROM it WHERE s = 120")
def _(t):
    out = curvefit.fit_weibull(daily(t), "total", "day", guess=((1.5, 0.02),), by="event_type")
    return out.select("event_type", "peak", F.round("m", 4).alias("m"), F.round("a", 5).alias("a"))


_TWO_PEAKS = _weibull_sql("""q AS (SELECT ts::DATE AS day, sum(value) AS y FROM events GROUP BY 1), o AS (SELECT y, row_number() OVER (ORDER BY day) AS i FROM q WHERE day IS NOT NULL),
d AS (SELECT (i > 15)::INT + 1 AS g, y, (CASE WHEN i > 15 THEN i - 15 ELSE i END)::DOUBLE AS t, sum(y) OVER (PARTITION BY i > 15) AS k FROM o)""", 1.2, 0.05)


@query("m13_weibull_two_peaks", f"WITH RECURSIVE {_TWO_PEAKS} SELECT g AS peak, round(m, 3) AS m, round(a, 4) AS a FROM it WHERE s = 120")
def _(t):
    all_days = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    out = curvefit.fit_weibull(all_days, "total", "day", regions=[(1, 15), (16, all_days.where("day is not null").count())], guess=((1.2, 0.05), (1.2, 0.05)))
    return out.select("peak", F.round("m", 3).alias("m"), F.round("a", 4).alias("a"))


@query("m14_arima_020", f"""
WITH {_DAILY}, d AS (SELECT event_type, total AS y, lag(total) OVER (PARTITION BY event_type ORDER BY day) AS p, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM daily)
SELECT event_type, k::INT AS step, round(y + k * (y - p), 2) AS total FROM d, range(1, 5) s(k) WHERE r = 1""")
def _(t):
    out = series.arima_forecast(daily(t), "total", "day", 0, 2, 0, 4, by="event_type")
    return out.withColumn("total", F.round("total", 2))


@query("m14_arima_ar1", f"""
WITH {_DAILY}, d AS (SELECT event_type, total AS w, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, lag(total) OVER (PARTITION BY event_type ORDER BY day) AS l,
 count(*) OVER (PARTITION BY event_type) AS c FROM daily),
s AS (SELECT event_type, any_value(c) n, max(CASE WHEN i = 1 THEN w END) w1, max(CASE WHEN i = c THEN w END) wn, sum(CASE WHEN i > 1 THEN w END) sw, sum(l) sl,
 sum(w * l) swl, sum(CASE WHEN i > 1 THEN w * w END) sww, sum(l * l) sll FROM d GROUP BY 1),
p0 AS (SELECT *, g / 1000.0 AS phi FROM s, range(-990, 991) r(g)),
m0 AS (SELECT *, ((1 - phi * phi) * w1 + (1 - phi) * (sw - phi * sl)) / ((1 - phi * phi) + (n - 1) * (1 - phi) * (1 - phi)) AS mu FROM p0),
l0 AS (SELECT *, n * ln((1 - phi * phi) * power(w1 - mu, 2) + sww + phi * phi * sll - 2 * phi * swl - 2 * mu * (1 - phi) * (sw - phi * sl) + (n - 1) * power(mu * (1 - phi), 2)) - ln(1 - phi * phi) AS nll FROM m0),
b0 AS (SELECT event_type, arg_min(phi, nll) AS phi FROM l0 GROUP BY 1),
p1 AS (SELECT s.*, b0.phi + g / 1000000.0 AS phi FROM s JOIN b0 USING (event_type), range(-1000, 1001) r(g)),
m1 AS (SELECT *, ((1 - phi * phi) * w1 + (1 - phi) * (sw - phi * sl)) / ((1 - phi * phi) + (n - 1) * (1 - phi) * (1 - phi)) AS mu FROM p1),
l1 AS (SELECT *, n * ln((1 - phi * phi) * power(w1 - mu, 2) + sww + phi * phi * sll - 2 * phi * swl - 2 * mu * (1 - phi) * (sw - phi * sl) + (n - 1) * power(mu * (1 - phi), 2)) - ln(1 - phi * phi) AS nll FROM m1),
b1 AS (SELECT event_type, arg_min(phi, nll) AS phi, arg_min(mu, nll) AS mu, any_value(wn) AS wn FROM l1 GROUP BY 1)
SELECT event_type, k::INT AS step, round(mu + power(phi, k) * (wn - mu), 1) AS total FROM b1, range(1, 6) r(k)""")
def _(t):
    out = series.arima_forecast(daily(t), "total", "day", 1, 0, 0, 5, by="event_type")
    return out.withColumn("total", F.round("total", 1))


def _arma_sql(tables: str, name: str, candidates: str, rows: str) -> str:
    """Exact likelihood of candidates (g, ph, th) of an ARMA(1, 1), value by value: innovations of the values (e) and of a constant (c), with variance v."""
    return f"""{tables}, {name}_n(g, ph, th, i, w, c, p, pc, v, ww, wc, cc, ld) AS (
 SELECT * FROM (SELECT k.g, ph::DOUBLE, th::DOUBLE, i, w::DOUBLE, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE, (1 + 2 * ph * th + th * th) / (1 - ph * ph) AS v, w * w / v, w / v, 1 / v, ln(v) FROM ({candidates}) k JOIN {rows} USING (g) WHERE i = 1)
 UNION ALL SELECT g, ph, th, i, w, 1::DOUBLE, p, pc, v, ww + (w - p) * (w - p) / v, wc + (w - p) * (1 - pc) / v, cc + (1 - pc) * (1 - pc) / v, ld + ln(v) FROM (
  SELECT n.g, ph, th, r.i, r.w, ph * n.w + th / v * (n.w - p) AS p, ph + th / v * (1 - pc) AS pc, 1 + th * th - th * th / v AS v, ww, wc, cc, ld FROM {name}_n n JOIN {rows} r ON r.g = n.g AND r.i = n.i + 1)),
{name} AS (SELECT n.* FROM {name}_n n JOIN (SELECT g, max(i) AS i FROM {rows} GROUP BY 1) z USING (g, i))"""


_MA = f"""{_DAILY}, y AS (SELECT event_type AS g, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, total - avg(total) OVER (PARTITION BY event_type) AS w,
 avg(total) OVER (PARTITION BY event_type) AS centre FROM daily)"""
_MA = _arma_sql(_MA, "a", "SELECT g, 0.0::DOUBLE AS ph, x / 1000.0 AS th FROM (SELECT DISTINCT g FROM y), range(-999, 1000) r(x)", "y")
_MA += ", b0 AS (SELECT g, arg_min(th, i * ln((ww - wc * wc / cc) / i) + ld) AS t0 FROM a GROUP BY 1)"
_MA = _arma_sql(_MA, "b", "SELECT g, 0.0::DOUBLE AS ph, greatest(-1, least(1, t0 + x / 1000000.0)) AS th FROM b0, range(-1000, 1001) r(x)", "y")


@query("m14_arima_ma1", f"""
WITH RECURSIVE {_MA}, f AS (SELECT g, arg_min(struct_pack(m := wc / cc, e := th * (w - p - wc / cc * (1 - pc)) / v), i * ln((ww - wc * wc / cc) / i) + ld) AS z FROM b GROUP BY 1)
SELECT g AS event_type, k::INT AS step, round((SELECT any_value(centre) FROM y WHERE y.g = f.g) + z.m + CASE WHEN k = 1 THEN z.e ELSE 0 END, 1) AS total FROM f, range(1, 4) s(k)""")
def _(t):
    out = series.arima_forecast(daily(t), "total", "day", 0, 0, 1, 3, by="event_type")
    return out.withColumn("total", F.round("total", 1))


_MIXED = f"""{_DAILY}, o AS (SELECT event_type AS g, total, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n, total - lag(total) OVER (PARTITION BY event_type ORDER BY day) AS w FROM daily),
y AS (SELECT g, n - 1 AS i, w, total FROM o WHERE n > 1)"""
_MIXED = _arma_sql(_MIXED, "a", "SELECT g, x / 50.0 AS ph, u / 50.0 AS th FROM (SELECT DISTINCT g FROM y), range(-49, 50) r(x), range(-50, 51) q(u)", "y")
for _was, _now, _step in (("a", "b", 0.001), ("b", "c", 0.00005), ("c", "d", 0.0000025)):
    _MIXED += f", {_now}0 AS (SELECT g, arg_min(struct_pack(ph := ph, th := th), i * ln(ww / i) + ld) AS z FROM {_was} GROUP BY 1)"
    _MIXED = _arma_sql(_MIXED, _now, f"SELECT DISTINCT g, greatest(-0.9999999, least(0.9999999, z.ph + x * {_step})) AS ph, greatest(-1, least(1, z.th + u * {_step})) AS th FROM {_now}0, range(-22, 23) r(x), range(-22, 23) q(u)", "y")


@query("m14_arima_111", f"""
WITH RECURSIVE {_MIXED}, f AS (SELECT g, arg_min(struct_pack(ph := ph, x := ph * w + th / v * (w - p)), i * ln(ww / i) + ld) AS z FROM d GROUP BY 1),
l AS (SELECT g, arg_max(total, i) AS total FROM y GROUP BY 1)
SELECT g AS event_type, k::INT AS step, round(total + z.x * (1 - power(z.ph, k)) / (1 - z.ph), 1) AS total FROM f JOIN l USING (g), range(1, 6) s(k)""")
def _(t):
    out = series.arima_forecast(daily(t), "total", "day", 1, 1, 1, 5, by="event_type")
    return out.withColumn("total", F.round("total", 1))


_CUT = "(SELECT max(ts)::DATE - 4 FROM events)"


@query("m15_gm1n", f"""
WITH {_DAILY}, r AS (SELECT event_type, day, n::DOUBLE AS n, CASE WHEN day >= {_CUT} THEN 0 ELSE total END AS y, day >= {_CUT} AS later,
 row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM daily),
c AS (SELECT *, sum(y) OVER w AS y1, sum(n) OVER w AS x1 FROM r WINDOW w AS (PARTITION BY event_type ORDER BY i)),
q AS (SELECT event_type, max(CASE WHEN i = 1 THEN y END) AS base, sum(b * b) FILTER (u) bb, sum(b * x1) FILTER (u) bx, sum(x1 * x1) FILTER (u) xx, sum(b * y) FILTER (u) yb, sum(x1 * y) FILTER (u) yx
 FROM (SELECT *, -(y1 - y / 2) AS b, NOT later AND i > 1 AS u FROM c) GROUP BY 1),
s AS (SELECT event_type, base, (xx * yb - bx * yx) / (bb * xx - bx * bx) AS al, (bb * yx - bx * yb) / (bb * xx - bx * bx) AS be FROM q),
f AS (SELECT c.*, (base - be * x1 / al) / exp(al * i) + be * x1 / al AS f FROM c JOIN s USING (event_type))
SELECT event_type, day, n, CASE WHEN g = 0 THEN 0 ELSE round(g / power(10, floor(log10(abs(g)))), 3) END AS mantissa
FROM (SELECT *, round(f - coalesce(lag(f) OVER (PARTITION BY event_type ORDER BY i), 0), 3) AS g FROM f) WHERE later""")
def _(t):
    d = daily(t)
    cut = t("events").agg(F.date_sub(F.max(F.to_date("ts")), 4)).first()[0]
    out = series.gm1n(d.where(F.col("day") < F.lit(cut)), d.where(F.col("day") >= F.lit(cut)), ["n"], "total", "day", by="event_type")
    # forecasts may be very large: compare leading digits
    g = F.col("gm1n_pre")
    lead = F.round(g / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(g)))), 3)
    return out.select("event_type", "day", "n", F.when(g == 0, 0.0).otherwise(lead).alias("mantissa"))


_FEATURES = """(SELECT p_partkey, any_value(p_brand) AS p_brand, any_value(p_size)::DOUBLE AS size, count(l_orderkey)::DOUBLE AS uses, round(coalesce(sum(l_quantity), 0), 2) AS volume, any_value(p_retailprice) AS price
 FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)"""


@query("m16_analogy", f"""
WITH f AS {_FEATURES}, m AS (SELECT max(size) ms, max(uses) mu, max(volume) mv FROM f),
v AS (SELECT f.*, size / ms * 0.3 AS a, uses / mu * 0.3 AS b, volume / mv * 0.4 AS c FROM f, m),
s AS (SELECT t.p_partkey, k.p_partkey AS kp, k.price AS e, round((least(t.a, k.a) + least(t.b, k.b) + least(t.c, k.c)) / (greatest(t.a, k.a) + greatest(t.b, k.b) + greatest(t.c, k.c)), 5) AS sim
 FROM v t, v k WHERE t.p_brand = 'Brand#7' AND k.p_brand <> 'Brand#7'),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, kp) AS r FROM s),
w AS (SELECT p_partkey, max(sim) FILTER (r = 1) b1, max(sim) FILTER (r = 2) b2, max(sim) FILTER (r = 3) b3, max(e) FILTER (r = 1) e1, max(e) FILTER (r = 2) e2, max(e) FILTER (r = 3) e3 FROM r WHERE r <= 3 GROUP BY 1)
SELECT p_partkey, round(1.1 * (b1 * e1 + (1 - b1) * b2 * e2 + (1 - b1) * (1 - b2) * b3 * e3 + (1 - b1) * (1 - b2) * (1 - b3) * (e1 + e2 + e3) / 3), 3) AS price FROM w""")
def _(t):
    per = t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).cast("double").alias("uses"), F.round(F.sum("l_quantity"), 2).alias("volume"))
    f = t("part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.coalesce("uses", F.lit(0.0)).alias("uses"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("p_retailprice").alias("price"))
    out = ana.analogy(f.where("p_brand <> 'Brand#7'"), f.where("p_brand = 'Brand#7'"), ["size", "uses", "volume"], "price",
                      {"size": 0.3, "uses": 0.3, "volume": 0.4}, 1.1, "p_partkey")
    return out.select("p_partkey", F.round("price", 3).alias("price"))


_EIGHT = ("size", "uses", "volume", "money", "taxes", "discounts", "returned", "by_air")
_EIGHT_SQL = """(SELECT p_partkey, p_brand, p_retailprice AS price, p_size::DOUBLE AS size, count(l_orderkey)::DOUBLE AS uses, coalesce(round(sum(l_quantity), 2), 0) AS volume,
 coalesce(round(sum(l_extendedprice), 2), 0) AS money, coalesce(round(sum(l_tax), 2), 0) AS taxes, coalesce(round(sum(l_discount), 2), 0) AS discounts,
 count(CASE WHEN l_returnflag = 'R' THEN 1 END)::DOUBLE AS returned, count(CASE WHEN l_linestatus = 'O' THEN 1 END)::DOUBLE AS by_air
 FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4)"""


@query("m16_analogy_eight_features", f"""
WITH f AS {_EIGHT_SQL}, m AS (SELECT {", ".join(f"max({c}) AS m_{c}" for c in _EIGHT)} FROM f),
v AS (SELECT p_partkey, p_brand, price, {", ".join(f"coalesce({c} / nullif(m_{c}, 0), 0) * 0.125 AS {c}" for c in _EIGHT)} FROM f, m),
s AS (SELECT t.p_partkey, k.p_partkey AS kp, k.price AS e,
 round(({" + ".join(f"least(t.{c}, k.{c})" for c in _EIGHT)}) / ({" + ".join(f"greatest(t.{c}, k.{c})" for c in _EIGHT)}), 5) AS sim
 FROM v t, v k WHERE t.p_brand = 'Brand#7' AND k.p_brand <> 'Brand#7'),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, kp) AS r FROM s),
w AS (SELECT p_partkey, max(sim) FILTER (r = 1) b1, max(sim) FILTER (r = 2) b2, max(sim) FILTER (r = 3) b3, max(e) FILTER (r = 1) e1, max(e) FILTER (r = 2) e2, max(e) FILTER (r = 3) e3 FROM r WHERE r <= 3 GROUP BY 1)
SELECT p_partkey, round(b1 * e1 + (1 - b1) * b2 * e2 + (1 - b1) * (1 - b2) * b3 * e3 + (1 - b1) * (1 - b2) * (1 - b3) * (e1 + e2 + e3) / 3, 3) AS price FROM w""")
def _(t):
    li, here = t("lineitem"), lambda c: F.count(F.when(c, 1)).cast("double")
    per = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).cast("double").alias("uses"), F.round(F.sum("l_quantity"), 2).alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("money"),
        F.round(F.sum("l_tax"), 2).alias("taxes"), F.round(F.sum("l_discount"), 2).alias("discounts"), here(F.col("l_returnflag") == "R").alias("returned"),
        here(F.col("l_linestatus") == "O").alias("by_air"))
    f = t("part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey", "p_brand", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _EIGHT[1:]])
    out = ana.analogy(f.where("p_brand <> 'Brand#7'"), f.where("p_brand = 'Brand#7'"), list(_EIGHT), "price", {c: 0.125 for c in _EIGHT}, 1.0, "p_partkey")
    return out.select("p_partkey", F.round("price", 3).alias("price"))


@query("m17_custom_trainer", f"WITH {_RIDGE} SELECT round(my - w0 * m1 - w1 * m2, 4) AS intercept, round(w0, 4) AS w0, round(w1, 4) AS w1 FROM w")
def _(t):
    custom.register("my_ridge", lambda df, strength: reg.fit_ridge(df, X2, Y, strength))
    return _line(t, custom.apply_custom("my_ridge", t("lineitem"), strength=1.0))


@query("m17_custom_per_group", """
SELECT event_type, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 4) AS intercept FROM events GROUP BY 1""")
def _(t):
    def sums(pdf):
        x, y = pdf["user_id"].astype(float), pdf["value"]
        return len(pdf), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()

    def add(a, b):
        return tuple(p + q for p, q in zip(a, b, strict=True))

    def line(key, s):
        n, x, y, xx, xy = s
        slope = (n * xy - x * y) / (n * xx - x * x)
        return {"event_type": key[0], "slope": round(slope, 6), "intercept": round((y - slope * x) / n, 4)}

    return custom.fit_per_group(t("events", "event_type", "value", "user_id"), "event_type", sums, add, line,
                                "event_type string, slope double, intercept double")


_APPLY = f"WITH {_RIDGE} SELECT l_quantity AS q, l_discount AS d, round(my - w0 * m1 - w1 * m2 + w0 * l_quantity + w1 * l_discount, 4) AS predicted FROM lineitem, w"


@query("e01_model_apply", _APPLY)
def _(t):
    model = reg.fit_ridge(t("lineitem"), X2, Y)
    out = models.model_apply(t("lineitem", *X2), model, ["q", "d", "predicted"])
    return out.withColumn("predicted", F.round("predicted", 4))


@query("e02_weibull_curve", f"""
WITH {_DAILY}, c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS peak, count(*) AS tm, round(sum(total), 2) AS cost FROM daily GROUP BY 1),
p AS (SELECT *, coalesce(sum(tm) OVER (ORDER BY peak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM c),
x AS (SELECT *, unnest(generate_series(1, tm)) AS t FROM p)
SELECT (skip + t)::BIGINT AS a, round(cost * (2.0 * 0.01 * t * exp(-0.01 * t * t)), 5) AS b FROM x""")
def _(t):
    from tablewright.core.layout import row_index

    costs = daily(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("time"), F.round(F.sum("total"), 2).alias("total_cost"))
    costs = row_index(costs, "event_type", name="peak")
    k = t("events").select("event_type").distinct().count()
    return models.model_apply(costs, models.WeibullModel((2.0,) * k, (0.01,) * k), ["a", "b"])


@query("e03_logarithm_apply", """
SELECT l_returnflag, l_quantity, round(regr_intercept(l_extendedprice, log10(l_quantity)) OVER (PARTITION BY l_returnflag)
 + regr_slope(l_extendedprice, log10(l_quantity)) OVER (PARTITION BY l_returnflag) * log10(l_quantity), 4) AS fit FROM lineitem""")
def _(t):
    params = curvefit.fit_logarithm(t("lineitem"), "l_quantity", Y, by="l_returnflag")
    out = curvefit.predict_grouped(t("lineitem", "l_returnflag", "l_quantity"), params, "l_returnflag", "l_quantity", "logarithm", "fit")
    return out.withColumn("fit", F.round("fit", 4))


@query("e03_exponential_apply", "SELECT p_partkey, round(3.0 * exp(-0.05 * p_size) + 1.5, 6) AS y FROM part")
def _(t):
    out = models.ExponentialModel("p_size", 3.0, 0.05, 1.5).predict(t("part", "p_partkey", "p_size"), "y")
    return out.select("p_partkey", F.round("y", 6).alias("y"))


@query("e04_saved_model", _APPLY)
def _(t):
    root, name = scratch(t, "models"), f"ridge_{uuid.uuid4().hex[:8]}"
    models.save_model(t.spark, reg.fit_ridge(t("lineitem"), X2, Y), root, name)
    out = models.model_apply(t("lineitem", *X2), models.load_model(t.spark, root, name), ["q", "d", "predicted"])
    return out.withColumn("predicted", F.round("predicted", 4))


@query("k04_model_versions", f"""
WITH {_RIDGE} SELECT l_linenumber AS line, 3 AS versions, round(avg(my - w0 * m1 - w1 * m2 + w0 * l_quantity + w1 * l_discount), 3) AS predicted FROM lineitem, w GROUP BY 1""")
def _(t):
    # three versions are saved; the second, asked for by its number, predicts the lines
    root = scratch(t, "models")
    tree = trees.fit_decision_tree(t("lineitem"), X2, Y, max_depth=2)
    versions = [models.save_model(t.spark, m, root, "m") for m in (tree, reg.fit_ridge(t("lineitem"), X2, Y), tree)]
    second = models.load_model(t.spark, root, "m", 2)
    return second.predict(t("lineitem", "l_linenumber", *X2), "p").groupBy(F.col("l_linenumber").alias("line")).agg(
        F.lit(max(versions)).alias("versions"), F.round(F.avg("p"), 3).alias("predicted"))


@query("k05_model_output", f"WITH {_RIDGE} SELECT round(w0, 4) AS w0 FROM w")
def _(t):
    from tablewright.plans.compose import Flow

    out = Flow(lambda lines: {"model": reg.fit_ridge(lines, X2, Y)}, "train").run(lines=t("lineitem"))
    return t.spark.createDataFrame([(round(out["model"].coef[0], 4),)], "w0 double")


# Truth and a simple prediction of it.
_PRED = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem"


def _pred(t):
    return t("lineitem").selectExpr("l_extendedprice y", "l_quantity * 1500 p")


@query("e05_regression_evaluate", f"""
WITH d AS ({_PRED}), s AS (SELECT avg(power(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM d)
SELECT 'r2' AS evaluate, round(1 - mse / v, 6) AS value FROM s UNION ALL SELECT 'mse', round(mse, 2) FROM s
UNION ALL SELECT 'rmse', round(sqrt(mse), 4) FROM s UNION ALL SELECT 'mae', round(mae, 4) FROM s""")
def _(t):
    out = evaluate.regression_evaluate(_pred(t), "y", "p")
    digits = F.when(F.col("evaluate") == "r2", F.round("value", 6)).when(F.col("evaluate") == "mse", F.round("value", 2))
    return out.withColumn("value", digits.otherwise(F.round("value", 4)))


@query("e05_incomplete_rows", """
WITH s AS (SELECT l_extendedprice y, CASE WHEN l_linenumber > 2 THEN l_quantity * 1500 END AS p FROM lineitem), k AS (SELECT * FROM s WHERE p IS NOT NULL),
m AS (SELECT avg(power(y - p, 2)) mse, avg(abs(y - p)) mae, var_pop(y) v FROM k)
SELECT unnest(['r2', 'mse', 'rmse', 'mae']) AS evaluate, round(unnest([1 - mse / v, mse, sqrt(mse), mae]), 4) AS value FROM m""")
def _(t):
    src = t("lineitem").selectExpr("l_extendedprice y", "if(l_linenumber > 2, l_quantity * 1500, null) p")
    return evaluate.regression_evaluate(src, "y", "p").withColumn("value", F.round("value", 4))


@query("e06_icc", f"""
WITH d AS ({_PRED}), s AS (SELECT count(*)::DOUBLE n, avg(y) - avg(p) AS g, covar_pop(y, y) * count(*) yy, covar_pop(y, p) * count(*) yp, covar_pop(p, p) * count(*) pp FROM d),
m AS (SELECT n, (yy + 2 * yp + pp) / 2 / (n - 1) AS b, n * g * g / 2 AS j, (yy - 2 * yp + pp) / 2 / (n - 1) AS e, ((yy - 2 * yp + pp) / 2 + n * g * g / 2) / n AS w FROM s)
SELECT 'ICC1' AS type, round((b - w) / (b + w), 6) AS icc FROM m UNION ALL SELECT 'ICC2', round((b - e) / (b + e + 2 * (j - e) / n), 6) FROM m
UNION ALL SELECT 'ICC3', round((b - e) / (b + e), 6) FROM m UNION ALL SELECT 'ICC1k', round((b - w) / b, 6) FROM m
UNION ALL SELECT 'ICC2k', round((b - e) / (b + (j - e) / n), 6) FROM m UNION ALL SELECT 'ICC3k', round((b - e) / b, 6) FROM m""")
def _(t):
    return evaluate.icc(_pred(t), "y", "p").select("type", F.round("icc", 6).alias("icc"))


@query("e07_classification_evaluate", """
WITH s AS (SELECT count(*)::DOUBLE n, sum((quality = 1 AND toxic = 1)::INT)::DOUBLE tp, sum((quality = 0 AND toxic = 0)::INT)::DOUBLE tn, sum(quality)::DOUBLE a, sum(toxic)::DOUBLE b FROM labels),
k AS (SELECT *, (tp + tn) / n AS po, (a * b + (n - a) * (n - b)) / n / n AS pe FROM s)
SELECT 'precision' AS evaluate, round(tp / b, 6) AS value FROM k UNION ALL SELECT 'recall', round(tp / a, 6) FROM k
UNION ALL SELECT 'f1', round(2 * tp / (a + b), 6) FROM k UNION ALL SELECT 'kappa', round((po - pe) / (1 - pe), 6) FROM k""")
def _(t):
    scored = t("labels").withColumn("score", F.col("toxic") * 0.8 + 0.1)
    return evaluate.classification_evaluate(scored, "quality", "score").withColumn("value", F.round("value", 6))


@query("e08_consistency", """
WITH c AS (SELECT l_returnflag a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END b, count(*)::DOUBLE n FROM lineitem GROUP BY 1, 2),
tot AS (SELECT sum(n) n, sum(n) FILTER (a = b) d FROM c), r AS (SELECT a k, sum(n) n FROM c GROUP BY 1), q AS (SELECT b k, sum(n) n FROM c GROUP BY 1),
e AS (SELECT sum(r.n * q.n) / (SELECT n * n FROM tot) AS pe FROM r JOIN q USING (k)), s AS (SELECT round((d / n - pe) / (1 - pe), 2) AS score FROM tot, e)
SELECT score, CASE WHEN score <= 0 THEN 'none' WHEN score <= 0.2 THEN 'slight' WHEN score <= 0.4 THEN 'weak' WHEN score <= 0.6 THEN 'moderate'
WHEN score <= 0.8 THEN 'strong' ELSE 'almost perfect' END AS band FROM s""")
def _(t):
    li = t("lineitem").selectExpr("l_returnflag a", "if(l_linestatus = 'O', 'N', l_returnflag) b")
    return evaluate.consistency(li, "a", "b")
