"""Projection, conversion, scaling, expansion and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from tablewright.functions.convert import to_text_column
from tablewright.operators import prep, relational as rel


@query("p01_column_filter", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def _(t):
    return rel.column_filter(t("lineitem"), ["l_shipdate", "l_orderkey", "l_quantity", "no_such"])


@query("p02_column_add", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(sqrt(l_quantity) + ln(l_quantity) * 2, 6) AS mix,
round(greatest(l_discount, l_tax) * l_quantity * l_quantity, 4) AS top FROM lineitem""")
def _(t):
    added = rel.column_add(t("lineitem"), [
        ("net", "l_extendedprice*(1-l_discount)"), ("mix", "sqrt(l_quantity) + log(l_quantity)*2"),
        ("top", "Max(l_discount, l_tax)*l_quantity^2")])
    return added.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), F.round("mix", 6).alias("mix"),
                        F.round("top", 4).alias("top"))


@query("p03_to_number", """
SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part""")
def _(t):
    text = t("part").selectExpr("p_partkey", "cast(p_size as string) p_size", "cast(p_retailprice as string) p_retailprice")
    return rel.type_convert(text, {"P_SIZE": "NUMBER", "p_retailprice": "NUMBER"})


@query("p03_date_to_number", "SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS o_orderdate FROM orders")
def _(t):
    return rel.type_convert(t("orders", "o_orderkey", "o_orderdate"), {"o_orderdate": "NUMBER"})


@query("p04_to_date", """
SELECT o_orderkey, o_orderdate AS a, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS b FROM orders""")
def _(t):
    text = t("orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') a",
                                  "if(o_orderstatus = 'F', 'NaT', date_format(o_orderdate, 'yyyy-MM-dd')) b")
    return rel.type_convert(text, {"a": "DATE", "b": "DATE"})


@query("p04_free_form_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (1, 3, 5) THEN date_trunc('day', o_orderdate) + INTERVAL (o_orderkey % 24) HOUR + INTERVAL (o_orderkey % 60) MINUTE
 WHEN o_orderkey % 10 = 9 THEN NULL ELSE date_trunc('day', o_orderdate) END AS d FROM orders""")
def _(t):
    clock = "lpad(o_orderkey % 24, 2, '0') || ':' || lpad(o_orderkey % 60, 2, '0')"
    half = ("if(o_orderkey % 12 = 0, 12, o_orderkey % 12) || ':' || lpad(o_orderkey % 60, 2, '0') || if(o_orderkey % 24 < 12, ' am', ' P.M.')")
    shapes = ["date_format(o_orderdate, 'yyyyMMdd')", f"date_format(o_orderdate, 'EEE, d MMM yyyy ') || {clock} || ' +0100'",
              "date_format(o_orderdate, 'MMMM d, yyyy')", f"date_format(o_orderdate, 'M/d/yyyy') || ' at ' || {half}",
              "date_format(o_orderdate, 'd-MMM-yy')", f"{clock} || date_format(o_orderdate, ' yyyy.MM.dd')", "date_format(o_orderdate, 'yyyy/M/d')",
              "date_format(o_orderdate, \"MMM d ''yy\")", "date_format(o_orderdate, 'dd') || 'th of ' || date_format(o_orderdate, 'MMM, yyyy')", "'NaT'"]
    cell = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shapes)) + " END d"
    return rel.type_convert(t("orders").selectExpr("o_orderkey", cell), {"d": "DATE"})


@query("p05_to_text", """
SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey::DOUBLE::VARCHAR END AS v FROM orders""")
def _(t):
    src = t("orders").selectExpr("o_orderkey", "if(o_orderstatus = 'F', double('NaN'), double(o_custkey)) v")
    return rel.type_convert(src, {"o_orderkey": "VARCHAR2", "v": "VARCHAR2"})


@query("p05_to_text_sizes", """
SELECT o_orderkey, (o_totalprice * 1000)::BIGINT::DECIMAL(30, 1)::VARCHAR AS v FROM orders""")
def _(t):
    src = t("orders").selectExpr("o_orderkey", "double(bigint(round(o_totalprice * 1000))) v")
    return rel.type_convert(src, {"v": "VARCHAR2"})


@query("p07_role_setting", """
SELECT l_orderkey, l_linenumber, l_quantity AS l_quantity_l, l_discount AS l_discount_l, l_extendedprice AS l_extendedprice_l
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10""")
def _(t):
    # the roles travel through a filter and a join, and say what is taken out
    li = rel.role_setting(t("lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice"])
    li = li.with_df(rel.data_filter(li.df, [("l_quantity", "NUMBER", "great_than", 10)]))
    both = rel.join_datasets(li, rel.role_setting(t("orders"), [], []), "l_orderkey", "o_orderkey", "inner")
    return both.df.select(F.col("l_orderkey_l").alias("l_orderkey"), F.col("l_linenumber_l").alias("l_linenumber"), *both.roles.x, *both.roles.y)


@query("p08_replicate", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(t):
    a, b = rel.replicate(t("nation", "n_nationkey", "n_name"), 2)
    return a.unionAll(b)


@query("p09_min_max_scale", """
SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 10) AS l_quantity, round((l_extendedprice - plo) / (phi - plo), 10) AS l_extendedprice
FROM lineitem, (SELECT min(l_quantity) lo, max(l_quantity) hi, min(l_extendedprice) plo, max(l_extendedprice) phi FROM lineitem)""")
def _(t):
    src = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return prep.min_max_scale(src, ["l_quantity", "l_extendedprice"])[0]


@query("p09_min_max_nan", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS p FROM orders)
SELECT o_orderkey, coalesce(round((p - lo) / (hi - lo), 10)::VARCHAR, 'nan') AS p FROM s, (SELECT min(p) lo, max(p) hi FROM s)""")
def _(t):
    src = t("orders").selectExpr("o_orderkey", "if(o_orderstatus = 'F', double('NaN'), o_totalprice) p")
    scaled = prep.min_max_scale(src, ["p"])[0]
    return scaled.select("o_orderkey", F.coalesce(to_text_column(F.col("p"), True), F.lit("nan")).alias("p"))


@query("p09_min_max_manual", "SELECT p_partkey, round((p_size - 10.0) / 20.0, 10) AS p_size FROM part")
def _(t):
    return prep.min_max_scale(t("part", "p_partkey", "p_size"), ["p_size"], {"p_size": (10.0, 30.0)})[0]


@query("p10_inverse_min_max", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS l_extendedprice, l_quantity FROM lineitem")
def _(t):
    src = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled, scaler = prep.min_max_scale(src, ["l_quantity", "l_extendedprice"])
    back = prep.inverse_min_max(scaled, ["l_quantity", "l_extendedprice"], scaler)
    return back.withColumns({"l_quantity": F.round("l_quantity", 4), "l_extendedprice": F.round("l_extendedprice", 4)})


@query("p11_natural_log", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6)::VARCHAR WHEN c_acctbal = 0 THEN 'zero' ELSE 'negative' END IS NOT NULL AS defined,
CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) ELSE -1 END AS v FROM customer""")
def _(t):
    out, _ = prep.column_process(t("customer", "c_custkey", "c_acctbal"), {"c_acctbal": "nplog"})
    v = F.col("c_acctbal")
    return out.select("c_custkey", v.isNotNull().alias("defined"),
                      F.when(F.isnan(v) | (v == F.lit(float("-inf"))), -1.0).otherwise(F.round(v, 6)).alias("v"))


@query("p12_boxcox_transform", """
WITH g AS (SELECT unnest(range(-500, 501)) / 100.0::DOUBLE AS lam),
u AS (SELECT ln(l_quantity) - (SELECT avg(ln(l_quantity)) FROM lineitem) AS u, count(*) AS w FROM lineitem GROUP BY 1),
v AS (SELECT lam, sum(w * y) / sum(w) AS m1, sum(w * y * y) / sum(w) AS m2 FROM
 (SELECT lam, w, CASE WHEN lam = 0 THEN u ELSE (exp(lam * u) - 1) / lam END AS y FROM g, u) GROUP BY 1),
best AS (SELECT lam FROM v ORDER BY m2 - m1 * m1 LIMIT 1)
SELECT l_quantity, count(*) AS n, round(any_value(lam), 2) AS lam FROM lineitem, best GROUP BY 1""")
def _(t):
    src = t("lineitem", "l_quantity")
    lam = prep.column_process(src, {"l_quantity": "boxcox"})[1]["l_quantity"]
    # lambda to two digits so that it can be checked against a plain grid
    return src.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).withColumn("lam", F.lit(round(lam, 2)))


@query("p13_polynomial", """
SELECT l_quantity AS "l_quantity", l_tax AS "l_tax", l_quantity * l_quantity AS "l_quantity^2", round(l_quantity * l_tax, 6) AS "l_quantity l_tax",
round(l_tax * l_tax, 6) AS "l_tax^2" FROM lineitem""")
def _(t):
    out = prep.polynomial(t("lineitem", "l_quantity", "l_tax"), degree=2)
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ("l_quantity l_tax", "l_tax^2")})


@query("p13_polynomial_interactions", """
SELECT l_quantity, l_discount, l_tax, round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_quantity * l_tax, 6) AS "l_quantity l_tax",
round(l_discount * l_tax, 6) AS "l_discount l_tax" FROM lineitem""")
def _(t):
    out = prep.polynomial(t("lineitem", "l_quantity", "l_discount", "l_tax"), degree=2, interaction_only=True)
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in out.columns if " " in c})


@query("p14_pca_project", """
WITH m AS (SELECT avg(l_quantity) mq, avg(l_discount) md, var_samp(l_quantity) a, covar_samp(l_quantity, l_discount) b, var_samp(l_discount) c FROM lineitem),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM m),
v AS (SELECT *, (lam - c) / sqrt((lam - c) * (lam - c) + b * b) AS v1, b / sqrt((lam - c) * (lam - c) + b * b) AS v2 FROM e)
SELECT l_tax, round((l_quantity - mq) * v1 + (l_discount - md) * v2, 6) AS x_1 FROM lineitem, v""")
def _(t):
    out = prep.pca_project(t("lineitem"), ["l_quantity", "l_discount"], ["l_tax"], 1)
    return out.select("l_tax", F.round("x_1", 6).alias("x_1"))


_BAND = "('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::BIGINT % 10000"


@query("p15_split_two", f"""
SELECT o_orderkey, CASE WHEN {_BAND} < 8000 THEN 'train' ELSE 'test' END AS part FROM orders""")
def _(t):
    parts = prep.data_split(t("orders", "o_orderkey"), "o_orderkey", 80, 20, seed=42)
    return parts["train"].withColumn("part", F.lit("train")).unionAll(parts["test"].withColumn("part", F.lit("test")))


@query("p15_split_exact", """
SELECT part, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= (SELECT count(*) - ceil(count(*) * 0.2) FROM orders)
THEN 'train' ELSE 'test' END AS part FROM orders) GROUP BY 1""")
def _(t):
    parts = prep.data_split(t("orders", "o_orderkey"), "o_orderkey", 80, 20, seed=42, exact=True)
    both = parts["train"].withColumn("part", F.lit("train")).unionAll(parts["test"].withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("p16_split_three", f"""
SELECT o_orderkey, CASE WHEN {_BAND} < 6000 THEN 'train' WHEN {_BAND} < 8000 THEN 'test' ELSE 'valid' END AS part FROM orders""")
def _(t):
    parts = prep.data_split(t("orders", "o_orderkey"), "o_orderkey", 60, 20, 20, seed=42)
    out = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("p17_split_override", """
SELECT l_returnflag AS part, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1""")
def _(t):
    li = t("lineitem")
    given = {"train": li.where("l_returnflag = 'N'"), "test": li.where("l_returnflag = 'A'"), "valid": li.where("l_returnflag = 'R'")}
    parts = prep.data_split(li, "l_orderkey", 60, 20, 20, override=given)
    out = parts["train"].unionAll(parts["test"]).unionAll(parts["valid"])
    return out.groupBy(F.col("l_returnflag").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("p17_split_one_override", """
SELECT 'test' AS part, count(*) AS n FROM orders WHERE ('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::BIGINT % 10000 >= 8000
UNION ALL SELECT 'train', count(*) FROM orders WHERE o_orderstatus = 'O'""")
def _(t):
    parts = prep.data_split(t("orders"), "o_orderkey", 80, 20, seed=42, override={"train": t("orders").where("o_orderstatus = 'O'")})
    return parts["train"].select(F.lit("train").alias("part")).unionAll(parts["test"].select(F.lit("test").alias("part"))).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"))


@query("p18_rename", 'SELECT r_regionkey AS "k.id", r_name AS "n.id" FROM region')
def _(t):
    return rel.rename(rel.rename(t("region"), ["k", "n"]), suffix=".id")


@query("p19_vector_roundtrip", "SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part")
def _(t):
    vec = prep.to_vector(t("part", "p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "v")
    return prep.from_vector(vec, "v", ["a", "b"]).select("p_partkey", "a", "b")


@query("p20_kpi_rows", """
SELECT m::INT AS pos, max(CASE WHEN l_returnflag = 'A' THEN q END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN q END) AS "N",
max(CASE WHEN l_returnflag = 'R' THEN q END) AS "R" FROM (
 SELECT l_returnflag, month(l_shipdate) - 1 AS m, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    monthly = t("lineitem").groupBy("l_returnflag", F.month("l_shipdate").alias("m")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    # twelve values per KPI
    cells = F.transform(F.array_sort(F.collect_list(F.struct("m", "q"))), lambda s: s["q"])
    arrays = monthly.groupBy(F.col("l_returnflag").alias("kpiName")).agg(cells.alias("value"))
    return prep.kpi_rows(arrays, ["A", "N", "R"])
