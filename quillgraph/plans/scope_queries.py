"""Scalar forms, prices, scope and field checks. A document's source stands for its group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import credits as C
from ..functions import text as T
from ..operators import scope as S
from .registry import Tables, query


@query("""SELECT doc_id, lang IN ('ar', 'he', 'fa', 'ur', 'yi') AS rtl, CASE WHEN doc_id % 7 = 0 THEN true ELSE false END AS rtl_made, CASE WHEN doc_id % 5 = 0 THEN '。！？．!?.' ELSE '.!?' END AS ends FROM documents""")
def locale_forms(t: Tables):
    made = F.when(F.col("doc_id") % 7 == 0, "he_IL").otherwise(F.col("lang"))
    ends = F.when(F.col("doc_id") % 5 == 0, "ja-JP").otherwise(F.col("lang"))
    return t.documents.select("doc_id", T.is_rtl(F.col("lang")).alias("rtl"), T.is_rtl(made).alias("rtl_made"), F.array_join(T.sentence_delimiters(ends), "").alias("ends"))


@query(r"""SELECT p_partkey, trim(p_name, ' ') AS stripped, '(?i)' || replace(replace(lower(p_name), '.', '\.'), ' ', '\s+') || '\s+\(x\)' AS pattern, 'the ' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' x' AS seed, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' Code' AS header,
CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name || '->' || p_brand END AS edge, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS key FROM part""")
def text_forms(t: Tables):
    name, size = F.col("p_name"), F.col("p_size")
    return t.part.select(
        "p_partkey",
        T.strip_tags(F.concat(F.lit("<skeleton id=3>"), name, F.lit("</skeleton> <Context>"))).alias("stripped"),
        T.keyword_pattern(F.concat(F.lit(" "), name, F.lit("  (x)"))).alias("pattern"),
        T.seed_phrase(F.concat(F.lit(" The -- "), name, F.lit("?! x"))).alias("seed"),
        T.header_text(F.concat(F.lower("p_type"), F.lit("_code"))).alias("header"),
        T.edge_id(name, F.col("p_brand"), F.when(size % 2 == 0, F.col("p_brand")).otherwise("")).alias("edge"),
        T.document_key(F.when(size % 3 == 0, " ").otherwise(name), F.lit(None).cast("string"), F.col("p_brand")).alias("key"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN substr(p_name || ' plain', 1, 80) ELSE p_name END AS title, CASE p_size % 3 WHEN 0 THEN p_brand || chr(10) || 'more' WHEN 1 THEN 'TITLE: ' || p_name || chr(10) || p_brand ELSE p_name || ' plain' || chr(10) || p_brand END AS summary FROM part""")
def community_summaries(t: Tables):
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit("TITLE: "), name, F.lit("\nSummary:  "), brand, F.lit("\nmore "))).when(size % 3 == 1, F.concat(F.lit("TITLE: "), name, F.lit("\n"), brand)).otherwise(F.concat(name, F.lit(" plain\n"), brand))
    return t.part.select("p_partkey", T.community_summary(text).alias("s")).select("p_partkey", "s.*")


_CREDITS = "GREATEST(CAST(ceil(round(({}) / 0.001, 6)) AS BIGINT), 1)"


@query(f"""WITH e AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS n FROM events) SELECT event_id, {_CREDITS.format('n * 0.05 / 1e6')} AS rerank, {_CREDITS.format('2 * (n / 3600.0) * 0.035')} AS graph, {_CREDITS.format('n * 10.0 / 1e6')} AS translation,
CASE WHEN n + n // 10 > 0 THEN {_CREDITS.format('n * 2.5 / 1e6 + (n // 10) * 10.0 / 1e6')} ELSE 0 END + CASE WHEN n // 100 > 0 THEN {_CREDITS.format('(n // 100) * 0.12 / 1e6')} ELSE 0 END AS query FROM e""")
def all_credits(t: Tables):
    n = F.floor(F.col("value") * 1000)
    part = lambda k: F.floor(n / k)
    return t.events.select(
        "event_id", C.rerank_credits(n).alias("rerank"), C.graph_credits(F.lit(2), n).alias("graph"), C.translation_credits(n).alias("translation"),
        C.query_credits(F.lit("large"), n, part(10), part(100), F.lit(0)).alias("query"),
    )


@query("SELECT doc_id, source FROM documents WHERE source IN ((SELECT MIN(source) FROM documents), '__global__')")
def tenant_documents(t: Tables):
    group = t.documents.agg(F.min("source")).first()[0]
    return S.tenant(t.documents, group, "source").select("doc_id", "source")


@query("SELECT o_orderkey AS doc_id, o_totalprice FROM orders WHERE o_custkey % 10 = 3")
def folder_filter(t: Tables):
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_totalprice")
    return S.in_folder(docs, t.orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 10).alias("folder")), F.lit(3))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'doc_x_chunk_1' ELSE p_name END AS name FROM part WHERE p_size % 4 <> 1")
def entities_without_chunk_ids(t: Tables):
    chunk = F.concat(F.lit(" DOC_"), F.substring(F.md5("p_name"), 1, 24), F.lit("_chunk_7"))
    name = F.when(F.col("p_size") % 4 == 1, chunk).when(F.col("p_size") % 4 == 0, "doc_x_chunk_1").otherwise(F.col("p_name"))
    return S.without_chunk_ids(t.part.select("p_partkey", name.alias("name")))


@query("SELECT p_partkey, p_size % 5 IN (0, 1, 2) AS generic, p_size % 3 = 0 AS role FROM part")
def generic_seeds(t: Tables):
    seed = F.element_at(F.array(F.lit("SWIFT-codes!"), F.lit(" ?"), F.lit("Tax ID"), F.col("p_name"), F.lit("the bicycle tax of the whole city")), F.col("p_size") % 5 + 1)
    return t.part.select("p_partkey", S.is_generic_seed(seed).alias("generic"), S.is_role_label(F.when(F.col("p_size") % 3 == 0, " Buyer").otherwise(F.col("p_name"))).alias("role"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click' AND event_type <> 'view' OR event_type = 'view' AND event_id % 2 = 0")
def category_filter(t: Tables):
    rows = t.events.select("event_id", "event_type", F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), F.lit(None)).otherwise(F.col("event_type")).alias("category"))
    return S.by_category(S.by_category(rows, exclude="click"), exclude="view").select("event_id", "event_type")


@query("SELECT conv_id AS doc_id, MAX(CAST(contains(lower(text), 'tion') AND turn > 1 OR contains(lower(text), 'zzz') AS INT)) = 1 AS found, arg_min(role, turn) FILTER (contains(lower(text), 'tion') AND turn > 1 OR contains(lower(text), 'zzz')) AS section FROM conversations GROUP BY conv_id")
def field_exists(t: Tables):
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("section"), F.when(F.col("turn") > 1, F.col("text")).otherwise("").alias("text"))
    return S.field_exists(rows, ["Tion", "zzz"])


@query("""WITH f AS (SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE regexp_matches(text, 'tion[,.]')), n AS (SELECT doc_id FROM f WHERE contains(CAST(doc_id AS VARCHAR), '7')) SELECT doc_id, 'named' AS scope FROM n UNION ALL SELECT doc_id, 'named' FROM f WHERE NOT EXISTS (SELECT 1 FROM n) UNION ALL SELECT doc_id, 'all' FROM f UNION ALL SELECT doc_id, 'none named' FROM f""")
def pattern_in_documents(t: Tables):
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), "text")
    titles = rows.select("doc_id", F.col("doc_id").cast("string").alias("title")).distinct()
    found = {"named": S.pattern_in_documents(rows, "tion[,.]", titles, "7"), "all": S.pattern_in_documents(rows, "tion[,.]"), "none named": S.pattern_in_documents(rows, "tion[,.]", titles, "no such title")}
    out = [df.withColumn("scope", F.lit(name)) for name, df in found.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])
