"""Registered queries of this subpackage, each over its whole table, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import chat, decontaminate, exact_dedup, filter_audit, licenses, packing, pii, runs, secret_scan, sharding, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.protect(docs, key="a key that the caller holds").select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"),
                                                                       F.array_join("found.kind", ",").alias("kinds"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_warc", r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from p left join g using (payload_digest)
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    number = {k: F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in secret_scan.KINDS[:3]}
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *number.values(), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


@query("op9_decontamination", r"""
with words as (
  select 'd' as kind, doc_id as id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents
  union all
  select 'i', item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') from benchmark),
shingles as (
  select distinct kind, id, n, array_to_string(w[i:i + n - 1], ' ') as s from (
    select kind, id, w, n, unnest(range(1, len(w) - n + 2)) as i
    from words, (select unnest([1, 2, 3, 4, 5]) as n) sizes
    where len(w) >= n and (kind = 'd' or n = least(5, len(w))))),
items as (select id as item_id, n, s, count(*) over (partition by id) as item_shingles from shingles where kind = 'i')
select d.id as doc_id, item_id, count(*) as shared, any_value(item_shingles) as item_shingles
from shingles d join items on d.n = items.n and d.s = items.s where d.kind = 'd'
group by d.id, item_id having count(*) >= 0.8 * any_value(item_shingles) - 1e-9
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; where the id's checksum h is a multiple of 10, the words from the a-th on repeat the p words from there."""
    words = F.array_remove(F.split(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.crc32(docs["doc_id"].cast("string").cast("binary")).alias("h"))
    changed = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    changed = changed.withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    changed = changed.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)) + 1)
    tail = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return changed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_repeated_runs")
def op11_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(repeated_tails(table(spark, sf_dir, "documents"))).withColumn("top", runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col("top")[f].alias(f) for f in ("start", "length", "period")],
                        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_filter_audit", r"""
with w as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
l as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels where doc_id is not null group by 1),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) over (partition by text), false)} as f
  from w left join l using (doc_id)),
c as (select part, f['A'] as a, f['B'] as b, f['C'] as c, f['D'] as d, f['E'] as e, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
k as (select part, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) as fails from c),
o as (select a || b || c || d || e as o from (select unnest(['A', 'B', 'C', 'D', 'E']) as a), (select unnest(['A', 'B', 'C', 'D', 'E']) as b),
    (select unnest(['A', 'B', 'C', 'D', 'E']) as c), (select unnest(['A', 'B', 'C', 'D', 'E']) as d), (select unnest(['A', 'B', 'C', 'D', 'E']) as e)
  where len(list_distinct([a, b, c, d, e])) = 5),
s as (select o, i, o[i] as own, o[:i - 1] as earlier from o, (select unnest([1, 2, 3, 4, 5]) as i)),
r as (select part, o, i, own, n, good, toxic, list_contains(fails, own) as hit, len(list_filter(fails, lambda x: contains(earlier, x))) > 0 as gone, len(fails) = 1 as alone from k, s),
t as (select part, o, i, own, sum(case when not gone and not hit then n else 0 end) as kept, sum(case when not gone and hit then n else 0 end) as removed,
    sum(case when gone and hit then n else 0 end) as redundant, sum(case when hit and alone then n else 0 end) as unique_fails,
    sum(case when not gone and hit then good else 0 end) as good_lost, sum(case when not gone and hit then toxic else 0 end) as toxic_lost from r group by all)
select part, o as filter_order, i::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from t
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_chat_format", r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' from (select unnest([0, 1]) as i)),
e as (select *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|/?INST>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') as body from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(23 + length(role) + length(body))::bigint as formatted_chars
from e group by conv_id
""")
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select -1L as conv_id, i as turn, if(i = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from range(2) r(i)")
    out = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    read = out.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
