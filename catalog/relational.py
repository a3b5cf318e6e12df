"""Filters, joins, aggregates, ranks and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from tablewright.core.layout import row_index, running_sum
from tablewright.core.session import ensure_checkpoint_dir
from tablewright.operators import aggregate as agg, relational as rel
from tablewright.sources.paging import paged
from tablewright.sources.tables import page, page_with_total


def flagship(t):
    """Filter, join, computed column, projection and rank over orders and their lines."""
    li = rel.data_filter(t("lineitem"), [("l_quantity", "NUMBER", "great_than", 10),
                                         ("l_discount", "NUMBER", "less_than_or_equal", 0.08)])
    joined = rel.data_join(t("orders"), li, "o_orderkey", "l_orderkey", "inner", suffixes=("", ""))
    priced = rel.column_add(joined, [("net", "l_extendedprice*(1-l_discount)"), ("gross", "net*(1+l_tax)")])
    kept = rel.column_filter(priced, ["o_orderkey", "o_custkey", "gross"])
    per = kept.groupBy("o_custkey").agg(F.round(F.sum("gross"), 2).alias("revenue"),
                                        F.countDistinct("o_orderkey").alias("n_orders"))
    return rel.rank_by_score(per, "revenue", "o_custkey")


@query("q00_customer_revenue_rank", """
SELECT o_custkey, revenue, n_orders, row_number() OVER (ORDER BY revenue DESC, o_custkey) AS ranking FROM (
 SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 10 AND l_discount <= 0.08 GROUP BY 1)""")
def _(t):
    return flagship(t)


@query("p06_filter_all", """
SELECT * FROM lineitem WHERE l_quantity >= 25 AND l_returnflag <> 'N' AND l_shipdate < TIMESTAMP '1999-01-01' """)
def _(t):
    return rel.data_filter(t("lineitem"), [
        ("l_quantity", "NUMBER", "great_than_or_equal", "25"), ("l_returnflag", "VARCHAR2", "not_equal", "N"),
        ("L_SHIPDATE", "DATE", "less_than", "1999-01-01 00:00:00")])


@query("p06_filter_any", """
SELECT o_orderkey, o_totalprice, st FROM (SELECT *, nullif(o_orderstatus, 'F') AS st FROM orders)
WHERE o_totalprice > 300000 OR o_totalprice <= 2000 OR st IS NULL""")
def _(t):
    o = t("orders").selectExpr("o_orderkey", "o_totalprice", "nullif(o_orderstatus, 'F') st")
    return rel.data_filter(o, [("o_totalprice", "NUMBER", "great_than", 300000),
                               ("o_totalprice", "NUMBER", "less_than_or_equal", 2000),
                               ("st", "VARCHAR2", "is_null", None)], "any")


@query("p06_filter_nulls", """
SELECT o_orderkey, st FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders) WHERE st IS NOT NULL AND st <> 'O' """)
def _(t):
    o = t("orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') st")
    return rel.data_filter(o, [("st", "VARCHAR2", "is_not_null", None), ("st", "VARCHAR2", "not_equal", "O")])


@query("j01_inner_join", """
SELECT o_orderkey AS o_orderkey_l, c_name AS c_name_r FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    return rel.data_join(t("orders"), t("customer"), "o_custkey", "c_custkey", "inner", ["o_orderkey_l", "c_name_r"])


@query("j01_inner_null_keys", """
SELECT o_orderkey AS o_orderkey_l, c_name AS c_name_r FROM orders JOIN customer
ON nullif(o_custkey, 3) IS NOT DISTINCT FROM nullif(c_custkey, 3)""")
def _(t):
    # customer 3 and its orders have no key, and meet all the same
    o = t("orders").selectExpr("o_orderkey", "nullif(o_custkey, 3) k")
    c = t("customer").selectExpr("c_name", "nullif(c_custkey, 3) k")
    return rel.data_join(o, c, "k", "k", "inner", ["o_orderkey_l", "c_name_r"])


@query("j02_left_join", """
SELECT p_partkey AS p_partkey_l, l_orderkey AS l_orderkey_r, l_quantity AS l_quantity_r FROM part LEFT JOIN lineitem ON p_partkey = l_partkey""")
def _(t):
    return rel.data_join(t("part"), t("lineitem"), "p_partkey", "l_partkey", "left",
                         ["p_partkey_l", "l_orderkey_r", "l_quantity_r"])


@query("j03_full_join", """
SELECT o_orderkey AS o_orderkey_l, l_orderkey AS l_orderkey_r, l_linenumber AS l_linenumber_r
FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') FULL JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    o = t("orders").where("o_orderstatus = 'O'")
    return rel.data_join(o, t("lineitem"), "o_orderkey", "l_orderkey", "full",
                         ["o_orderkey_l", "l_orderkey_r", "l_linenumber_r"])


@query("j04_display_columns", """
SELECT n_name AS n_name_a, r_name AS r_name_b, n_regionkey AS n_regionkey_a FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    return rel.data_join(t("nation"), t("region"), "n_regionkey", "r_regionkey", "left",
                         ["r_name_b", "n_name_a", "n_regionkey_a", "unknown"], ("_a", "_b"))


@query("j05_empty_side", "SELECT c_custkey AS c_custkey_l, NULL::BIGINT AS o_orderkey_r FROM customer")
def _(t):
    return rel.data_join(t("customer"), t("orders").where("false"), "c_custkey", "o_custkey", "full",
                         ["c_custkey_l", "o_orderkey_r"])


@query("j07_multiway_left", """
SELECT c_custkey, n_name, r_name, count(o_orderkey) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def _(t):
    n = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))  # before the join
    c = t("customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    named = c.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("j07_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _(t):
    rich = t("orders").where("o_totalprice > 250000")
    return t("customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("g01_min_max", """
SELECT 'l_quantity' AS name, min(l_quantity) AS "min", max(l_quantity) AS "max" FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem""")
def _(t):
    return agg.column_min_max(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("g02_mean_std", """
SELECT 'l_quantity' AS name, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, count(l_quantity) AS n FROM lineitem
UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), count(l_discount) FROM lineitem""")
def _(t):
    out = agg.column_stats(t("lineitem"), ["l_quantity", "l_discount"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("g05_daily_counts", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def _(t):
    return agg.daily_counts(t("events"), "ts", "2024-01-03 00:00:00", "2024-01-20 00:00:00")


@query("g06_conditional_counts", """
SELECT user_id, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failure FROM events GROUP BY 1""")
def _(t):
    bad = F.col("event_type") == "error"
    return agg.conditional_counts(t("events"), {"success": ~bad, "failure": bad}, "user_id")


@query("g07_group_counts", "SELECT conv_id, count(*) AS n, max(turn) AS max_turn FROM conversations GROUP BY 1")
def _(t):
    return agg.group_counts(t("conversations"), "conv_id", "turn")


@query("w01_latest_per_key", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) r FROM events) WHERE r = 1""")
def _(t):
    return rel.latest_per_key(t("events"), "user_id", [F.col("ts").desc(), F.col("event_id")]).select(
        "user_id", "event_id", "event_type")


@query("w02_rank_desc", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ranking FROM orders")
def _(t):
    return rel.rank_by_score(t("orders", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("w03_running_sum", """
SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS total FROM events""")
def _(t):
    out = running_sum(t("events"), {"total": "value"}, ["ts", "event_id"], by="event_type")
    return out.select("event_id", "event_type", F.round("total", 4).alias("total"))


@query("w04_adjacent_mean", """
SELECT event_id, event_type, round((y + lag(y) OVER w) / 2, 4) AS z FROM (
 SELECT *, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def _(t):
    from tablewright.core.layout import lagged

    rows = row_index(t("events"), ["ts", "event_id"], by="event_type", name="i")
    rows = running_sum(rows, {"y": "value"}, "i", by="event_type")
    rows = lagged(rows, ["y"], 1, "i", by="event_type")
    return rows.select("event_id", "event_type", F.round((F.col("y") + F.col("y_lag1")) / 2, 4).alias("z"))


@query("w05_row_index", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_index FROM events")
def _(t):
    return row_index(t("events"), ["ts", "event_id"], by="event_type").select("event_id", "event_type", "row_index")


@query("l01_order_by", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey DESC")
def _(t):
    return t("orders", "o_custkey", "o_orderkey").orderBy("o_custkey", F.col("o_orderkey").desc())


@query("l02_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return page(t("orders", "o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 25)


@query("l02_page_total", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def _(t):
    return page_with_total(t("orders", "o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 25)


@query("l02_deep_page", """
SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total
FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5 OFFSET 4995""")
def _(t):
    rows = t("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    return paged(rows, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], path).page_with_total(t.spark, 1000, 5)


@query("l03_top_k_per_group", """
SELECT o_orderpriority, o_orderkey, ranking FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS ranking
FROM orders) WHERE ranking <= 3""")
def _(t):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return rel.top_k_per_group(t("orders"), "o_orderpriority", order, 3, "ranking").select(
        "o_orderpriority", "o_orderkey", F.col("ranking").cast("long").alias("ranking"))


@query("u01_union_fill", """
SELECT c_custkey AS id, c_acctbal AS balance, 0.0::DOUBLE AS label FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1.0 FROM supplier""")
def _(t):
    c = t("customer").selectExpr("c_custkey id", "c_acctbal balance")
    s = t("supplier").selectExpr("s_suppkey id", "s_acctbal balance", "cast(1.0 as double) label")
    return rel.union_all(s, c, {"label": 0.0})


@query("u02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return rel.union_distinct(t("customer").selectExpr("c_nationkey k"), t("supplier").selectExpr("s_nationkey k"))


@query("u03_distinct_by", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders) WHERE r = 1""")
def _(t):
    return rel.distinct_by(t("orders", "o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")])
