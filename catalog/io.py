"""Sources, generators and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from tablewright.core.session import ensure_checkpoint_dir
from tablewright.operators.relational import column_filter
from tablewright.sources import files, generators as gen, sinks, tables


def scratch(t, kind: str) -> str:
    """Fresh path in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@query("s01_parquet_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return tables.read_table(t.spark, "parquet", f"{t.sf_dir}/customer.parquet",
                             ["c_custkey", "c_name", "c_acctbal"])


@query("s02_table_scan", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    t("supplier").createOrReplaceTempView("tw_supplier")
    return tables.read_table(t.spark, "table", "tw_supplier", ["s_suppkey", "s_name"])


@query("s03_bind_table", """
SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderdate AS o_orderdate, o_orderstatus FROM orders""")
def _(t):
    payload = t("orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return tables.bind_table(payload, [("o_orderkey", "NUMBER"), ("o_orderdate", "DATE"),
                                       ("o_orderstatus", "VARCHAR2")])


@query("s04_int_range", """
WITH b AS (SELECT min(l_quantity)::BIGINT lo, max(l_quantity)::BIGINT hi FROM lineitem),
r AS (SELECT unnest(generate_series(lo, hi, 1)) AS quantity FROM b)
SELECT r.quantity, count(l_orderkey) AS n FROM r LEFT JOIN lineitem ON l_quantity = r.quantity GROUP BY 1""")
def _(t):
    li = t("lineitem", "l_quantity")
    lo, hi = li.agg(F.min("l_quantity").cast("long"), F.max("l_quantity").cast("long")).first()
    counts = li.groupBy(F.col("l_quantity").cast("long").alias("quantity")).agg(F.count(F.lit(1)).alias("n"))
    return gen.int_range(t.spark, lo, hi, 1, "quantity").join(counts, "quantity", "left").fillna(0, ["n"])


@query("s05_year_range", """
WITH b AS (SELECT min(year(o_orderdate)) lo, max(year(o_orderdate)) hi FROM orders),
r AS (SELECT unnest(generate_series(lo, hi, 1)) AS year FROM b)
SELECT r.year::BIGINT AS year, count(o_orderkey) AS n FROM r LEFT JOIN orders ON year(o_orderdate) = r.year GROUP BY 1""")
def _(t):
    o = t("orders", "o_orderdate")
    lo, hi = o.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    counts = o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return gen.year_range(t.spark, lo, hi).join(counts, "year", "left").fillna(0, ["n"])


def _calendar(t, pattern, make, name):
    o = t("orders", "o_orderdate")
    key = F.date_format("o_orderdate", pattern)
    lo, hi = o.agg(F.min(key), F.max(key)).first()
    counts = o.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return make(t.spark, lo, hi).join(counts, name, "left").fillna(0, ["n"])


@query("s06_month_range", """
WITH b AS (SELECT date_trunc('month', min(o_orderdate)) lo, max(o_orderdate) hi FROM orders),
r AS (SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM b)
SELECT r.month, count(o_orderkey) AS n FROM r LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m') = r.month GROUP BY 1""")
def _(t):
    return _calendar(t, "yyyy-MM", gen.month_range, "month")


@query("s06_day_range", """
WITH b AS (SELECT min(o_orderdate)::DATE lo, max(o_orderdate)::DATE hi FROM orders),
r AS (SELECT strftime(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM b)
SELECT r.day, count(o_orderkey) AS n FROM r LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m-%d') = r.day GROUP BY 1""")
def _(t):
    return _calendar(t, "yyyy-MM-dd", gen.day_range, "day")


@query("s07_single_value", """
SELECT (SELECT max(o_totalprice) FROM orders) AS value, o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS share
FROM orders""")
def _(t):
    o = t("orders", "o_orderkey", "o_totalprice")
    one = gen.single_value(t.spark, o.agg(F.max("o_totalprice")).first()[0])
    joined = o.join(F.broadcast(one), how="cross")  # one-row side
    return joined.select("value", "o_orderkey", F.round(F.col("o_totalprice") / F.col("value"), 6).alias("share"))


@query("s08_monte_carlo", """
WITH b AS (SELECT min(p_retailprice) plo, max(p_retailprice) phi, min(p_size)::DOUBLE slo, max(p_size)::DOUBLE shi, count(*) n FROM part),
r AS (SELECT unnest(generate_series(0, n - 1)) AS id, * FROM b),
u AS (SELECT *, ('0x' || substr(md5(id || ':7:price'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE up,
  ('0x' || substr(md5(id || ':7:size'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE us FROM r)
SELECT round(plo + (phi - plo) * up, 6) AS price, round(slo + (shi - slo) * us, 6) AS size FROM u""")
def _(t):
    lo, hi, slo, shi, n = t("part").agg(
        F.min("p_retailprice"), F.max("p_retailprice"), F.min("p_size"), F.max("p_size"), F.count(F.lit(1))).first()
    drawn = gen.monte_carlo(t.spark, n, {"price": (lo, hi), "size": (slo, shi)}, seed=7)
    return drawn.select(F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query("s09_csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch(t, "csv")
    src = t("customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    src.write.option("header", True).csv(path)
    return tables.read_table(t.spark, "csv", path, schema=src.schema)


@query("s10_snapshot", "SELECT s_suppkey, s_name, s_acctbal, true AS stamped FROM supplier")
def _(t):
    name = f"tw_{uuid.uuid4().hex[:12]}"
    sinks.snapshot(t("supplier"), name, path=scratch(t, "snapshot"))
    return t.spark.table(name).select("s_suppkey", "s_name", "s_acctbal", F.col("load_ts").isNotNull().alias("stamped"))


@query("s11_create_table", "SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_retailprice FROM part")
def _(t):
    made = sinks.create_table(t.spark, t("part"), [("p_partkey", "NUMBER"), ("p_name", "VARCHAR2"), ("p_retailprice", "NUMBER")],
                              f"tw_{uuid.uuid4().hex[:12]}", path=scratch(t, "created"))
    return made.drop("load_ts")


@query("s12_formula_table", """
SELECT i, (i * i + 1.0)::DOUBLE AS a, round(sqrt(i * i + 1.0) / 2, 6) AS b
FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM orders))) AS i)""")
def _(t):
    made = gen.formula_table(t.spark, t("orders").count(), [("a", "i^2 + 1"), ("b", "sqrt(a) / 2")])
    return made.withColumn("b", F.round("b", 6))


@query("s13_describe_columns", """
WITH k AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS "position", unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name,
 unnest(['NUMBER', 'NUMBER', 'VARCHAR2', 'NUMBER', 'DATE', 'VARCHAR2']) AS data_type,
 unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice), count(o_orderdate), count(o_orderpriority)]) AS present,
 unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice), count(DISTINCT o_orderdate), count(DISTINCT o_orderpriority)]) AS different FROM orders)
SELECT * FROM k""")
def _(t):
    described = tables.describe_source(t.spark, "parquet", f"{t.sf_dir}/orders.parquet").select("position", "name", "data_type")
    return described.join(tables.column_counts(t("orders")), "name")


@query("s14_preview_search", """
SELECT * FROM part WHERE concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) LIKE '%red%'
ORDER BY p_partkey LIMIT 10 OFFSET 10""")
def _(t):
    return tables.preview(t("part"), "p_partkey", "red", page_no=2, size=10)


@query("k01_map_columns", "SELECT c_custkey AS id, c_name AS label FROM customer")
def _(t):
    return sinks.map_columns(t("customer"), [("c_custkey", "id"), ("c_name", "label")], ["id", "label", "extra"])


@query("k01_append_mapped", """
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL FROM customer""")
def _(t):
    name = f"tw_{uuid.uuid4().hex[:12]}"
    s = t("supplier").selectExpr("s_suppkey key", "s_name name", "s_acctbal balance")
    s.write.option("path", scratch(t, "append")).saveAsTable(name)
    sinks.append_mapped(t("customer"), name, [("c_custkey", "key"), ("c_name", "name")])
    return t.spark.table(name)


@query("k02_publish", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    sinks.publish({"nations": t("nation")}, "tw_")
    return column_filter(t.spark.table("tw_nations"), ["n_nationkey", "n_name"])


@query("k03_checkpoint", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return sinks.checkpoint(t("orders", "o_orderkey", "o_totalprice"), scratch(t, "node"))


@query("k06_append_stamped", "SELECT n_nationkey, n_name, true AS stamped FROM nation UNION ALL SELECT n_nationkey, n_name, true FROM nation")
def _(t):
    name = f"tw_{uuid.uuid4().hex[:12]}"
    sinks.snapshot(t("nation"), name, path=scratch(t, "stamped"))
    sinks.append(t("nation"), name)
    return t.spark.table(name).select("n_nationkey", "n_name", F.col("load_ts").isNotNull().alias("stamped"))


@query("k07_update_by_key", """
SELECT c_custkey, CASE WHEN n > 0 THEN s ELSE c_acctbal END AS c_acctbal FROM customer
LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) s, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    new = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return sinks.update_by_key(t("customer", "c_custkey", "c_acctbal"), new, "c_custkey")


@query("k08_delete_by_key", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(t):
    keys = t("lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return sinks.delete_by_key(t("part", "p_partkey", "p_name"), keys, "p_partkey")


@query("k09_add_column", "SELECT r_regionkey, r_name, NULL::VARCHAR AS tag FROM region")
def _(t):
    return sinks.add_column(t("region"), "tag", "VARCHAR2")


@query("k10_upsert", """
SELECT coalesce(s_suppkey, c_custkey) AS key, CASE WHEN c_custkey IS NULL THEN s_name ELSE c_name END AS name, s_acctbal AS balance
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def _(t):
    base = t("supplier").selectExpr("s_suppkey key", "s_name name", "s_acctbal balance")
    return sinks.upsert(base, t("customer").selectExpr("c_custkey key", "c_name name"), "key")


def edited(t, df, key):
    """Path of an editable table with the rows of ``df``."""
    path = scratch(t, "files")
    files.create_files(df, path, key)
    return path


@query("k07_update_files", """
SELECT o_orderkey, o_custkey, CASE WHEN s_suppkey IS NULL THEN o_totalprice ELSE s_acctbal END AS o_totalprice
FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey""")
def _(t):
    path = edited(t, t("orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    new = t("supplier").selectExpr("s_suppkey o_orderkey", "s_acctbal o_totalprice")
    return files.update_files(new, path, "o_orderkey").read(t.spark)


@query("k08_delete_files", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    path = edited(t, t("orders", "o_orderkey", "o_custkey"), "o_orderkey")
    return files.delete_files(t("customer").selectExpr("c_custkey o_orderkey"), path, "o_orderkey").read(t.spark)


@query("k10_upsert_files", """
SELECT coalesce(c_custkey, p_partkey) AS key, CASE WHEN p_partkey IS NULL THEN c_name ELSE p_name END AS name, c_acctbal AS balance, p_size::DOUBLE AS size
FROM customer FULL JOIN part ON c_custkey = p_partkey""")
def _(t):
    path = edited(t, t("customer").selectExpr("c_custkey key", "c_name name", "c_acctbal balance"), "key")
    files.add_file_column(path, "size", "NUMBER")
    return files.upsert_files(t("part").selectExpr("p_partkey key", "p_name name", "p_size size"), path, "key").read(t.spark)
