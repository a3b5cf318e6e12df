"""Text, charts and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from tablewright.operators import charts, custom, relational as rel, text
from tablewright.plans.compose import Flow, insight, insight_summary

_STOP = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in sorted(set(text.STOP_CHARACTERS)) if c != "\n") + ", chr(10)]"
_TOKEN = r"([a-zA-Z0-9]+(?:\.[0-9]+)?%?|[^a-zA-Z0-9])"
_CUT = f"[x FOR x IN regexp_extract_all(text, '{_TOKEN}', 1) IF NOT list_contains({_STOP}, x)]"


@query("t01_cut_word", f"SELECT doc_id, CASE WHEN length(text) > 0 THEN array_to_string({_CUT}, '、') END AS seg_result FROM documents")
def _(t):
    return text.cut_word(t("documents", "doc_id", "text"), "text").select("doc_id", "seg_result")


@query("t02_word_count", f"""
WITH w AS (SELECT doc_id, unnest({_CUT}) AS word FROM documents)
SELECT doc_id::VARCHAR AS node_id, NULL AS parent_id, doc_id, lang, NULL AS tag_result, NULL::BIGINT AS word_count FROM documents
UNION ALL SELECT doc_id || '/' || word, doc_id::VARCHAR, NULL, NULL, word, count(*) FROM w GROUP BY doc_id, word""")
def _(t):
    return text.word_count(t("documents", "doc_id", "lang", "text"), "doc_id", "text").drop("text")


@query("t03_word_tag", f"""
WITH w AS (SELECT doc_id, unnest({_CUT}) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(trim(word)) >= 2 AND lower(word) NOT IN ({", ".join(f"'{s}'" for s in text.STOP_WORDS)}) GROUP BY 1, 2),
f AS (SELECT word, count(*) AS df FROM c GROUP BY 1), d AS (SELECT count(*) AS docs FROM documents), s AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1),
k AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY round(n * ln(docs::DOUBLE / df) / total, 12) DESC, word) AS r FROM c JOIN f USING (word) JOIN s USING (doc_id), d)
SELECT doc_id, coalesce(string_agg(word, '、' ORDER BY r), '') AS tag_result FROM documents LEFT JOIN (SELECT * FROM k WHERE r <= 5) USING (doc_id) GROUP BY 1""")
def _(t):
    return text.word_tag(t("documents", "doc_id", "text"), "doc_id", "text", 5).select("doc_id", "tag_result")


@query("c01_scatter", "SELECT l_quantity, l_extendedprice FROM lineitem")
def _(t):
    return charts.chart_scatter(t("lineitem"), "l_quantity", "l_extendedprice")


@query("c01_scatter_bins", """
WITH e AS (SELECT min(o_custkey)::DOUBLE a, (max(o_custkey) - min(o_custkey)) / 20.0 w, min(o_totalprice) b, (max(o_totalprice) - min(o_totalprice)) / 20.0 h FROM orders),
c AS (SELECT least(floor((o_custkey - a) / w), 19) i, least(floor((o_totalprice - b) / h), 19) j FROM orders, e)
SELECT round(a + i * w, 4) AS x_low, round(a + (i + 1) * w, 4) AS x_high, round(b + j * h, 4) AS y_low, round(b + (j + 1) * h, 4) AS y_high, count(*) AS n
FROM c, e GROUP BY 1, 2, 3, 4""")
def _(t):
    cells = charts.chart_scatter(t("orders"), "o_custkey", "o_totalprice", "aggregate", 20)
    return cells.select(*[F.round(c, 4).alias(c) for c in ("x_low", "x_high", "y_low", "y_high")], "n")


@query("c01_sample_share", """
SELECT o_custkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(o_orderkey || ':0'), 1, 8))::BIGINT % 10000 < 2500""")
def _(t):
    return charts.sample_share(t("orders"), "o_orderkey", 0.25).select("o_custkey", "o_totalprice")


@query("c02_line", "SELECT l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1")
def _(t):
    out = charts.chart_line(t("lineitem"), "l_quantity", "l_extendedprice", "aggregate")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("c03_histogram", "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY 1")
def _(t):
    return charts.chart_histogram(t("lineitem"), "l_returnflag", "l_quantity", "aggregate").withColumn("l_quantity", F.round("l_quantity", 2))


@query("c03_histogram_bins", """
WITH b AS (SELECT min(o_totalprice) lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)
SELECT least(floor((o_totalprice - lo) / w), 19)::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def _(t):
    return charts.chart_histogram(t("orders"), "o_totalprice", mode="aggregate", bins=20).select("bin", "n")


@query("c04_pie", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY 1""")
def _(t):
    out = charts.chart_pie(t("orders"), "o_orderpriority", "o_totalprice", "aggregate")
    return out.withColumns({"o_totalprice": F.round("o_totalprice", 2), "share": F.round("share", 6)})


@query("c05_spider", """
SELECT 'l_quantity' AS dimension, round(avg(l_quantity), 6) AS value FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_tax', round(avg(l_tax), 6) FROM lineitem""")
def _(t):
    return charts.chart_spider(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "aggregate").withColumn("value", F.round("value", 6))


@query("c06_bubble", "SELECT l_quantity, l_discount, count(*) AS size FROM lineitem GROUP BY 1, 2")
def _(t):
    return charts.chart_bubble(t("lineitem"), "l_quantity", "l_discount", "aggregate")


@query("c07_tree", """
WITH c AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS pid, c_name AS name, c_acctbal AS value FROM customer),
n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS pid, n_name AS name, 0.0::DOUBLE AS value FROM nation),
r AS (SELECT 'r' || r_regionkey AS id, NULL AS pid, r_name AS name, 0.0::DOUBLE AS value FROM region)
SELECT *, round(value, 2) AS subtree_total FROM c
UNION ALL SELECT n.*, round(coalesce((SELECT sum(value) FROM c WHERE c.pid = n.id), 0), 2) FROM n
UNION ALL SELECT r.*, round(coalesce((SELECT sum(c.value) FROM c JOIN n ON c.pid = n.id WHERE n.pid = r.id), 0), 2) FROM r""")
def _(t):
    c = t("customer").selectExpr("concat('c', c_custkey) id", "concat('n', c_nationkey) pid", "c_name name", "c_acctbal value")
    n = t("nation").selectExpr("concat('n', n_nationkey) id", "concat('r', n_regionkey) pid", "n_name name", "double(0) value")
    r = t("region").selectExpr("concat('r', r_regionkey) id", "cast(null as string) pid", "r_name name", "double(0) value")
    out = charts.chart_tree(c.unionAll(n).unionAll(r), "id", "pid", "name", "value", "aggregate")
    return out.withColumn("subtree_total", F.round("subtree_total", 2))


@query("c08_box", """
SELECT l_returnflag, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS high FROM lineitem GROUP BY 1""")
def _(t):
    out = charts.chart_box(t("lineitem"), "l_returnflag", "l_extendedprice", "aggregate")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("x01_custom_formula", """
SELECT c_custkey, round(c_acctbal + coalesce(s, 0), 2) AS exposure FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    def exposure(customers, orders):
        spent = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
        joined = customers.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
        return joined.select("c_custkey", F.round(F.col("c_acctbal") + F.coalesce("s", F.lit(0.0)), 2).alias("exposure"))

    custom.register("exposure", exposure)
    return custom.apply_custom("exposure", t("customer"), t("orders"))


@query("x01_custom_batches", "SELECT p_partkey, p_retailprice * 2 AS doubled FROM part")
def _(t):
    return custom.apply_batches(t("part", "p_partkey", "p_retailprice"),
                                lambda pdf: pdf.assign(doubled=pdf.p_retailprice * 2)[["p_partkey", "doubled"]],
                                "p_partkey long, doubled double")


def _big_orders(t):
    def big(orders, customers):
        kept = rel.data_filter(orders, [("o_totalprice", "NUMBER", "great_than", 200000)])
        named = rel.data_join(kept, customers, "o_custkey", "c_custkey", "left", suffixes=("", ""))
        return {"orders": kept, "named": rel.column_filter(named, ["o_orderkey", "c_name"])}

    return Flow(big)


@query("x02_nested_flow", """
SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1""")
def _(t):
    inner = _big_orders(t)

    def outer(orders, customers):
        named = inner.run_in_order(orders, customers)["named"]
        return {"counts": named.groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))}

    return Flow(outer).run(orders=t("orders"), customers=t("customer"))["counts"]


@query("x03_partial_run", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000")
def _(t):
    return _big_orders(t).run_to("orders", orders=t("orders"), customers=t("customer")).select("o_orderkey", "o_custkey")


@query("x04_insight_summary", """
SELECT 'o_orderkey' AS name, count(*) AS rows, count(*) - count(o_orderkey) AS missing, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders""")
def _(t):
    return insight_summary(t("orders", "o_orderkey", "o_orderstatus"))


@query("x04_insight_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    return insight(t("orders", "o_orderkey", "o_totalprice"), 100, ["o_orderkey"])
