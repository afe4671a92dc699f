"""Facts, checks and seams. Parts stand for names and chunks, conversations for questions and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as A
from . import fixture as X
from .fixture import RELATIONS
from .registry import Tables, query

_W = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9$% ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda x: x <> ''))"
_CHUNK = "chunk AS (SELECT o_orderkey AS chunk_id, c_name || ' met Big ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Blue House and New Yorker' ELSE 'Red Barn' END || ' today' AS text FROM orders JOIN customer ON c_custkey = o_custkey)"


def _chunks(t: Tables):
    place = F.when(F.col("o_orderkey") % 2 == 0, "Blue House and New Yorker").otherwise("Red Barn")
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("chunk_id"), F.concat("c_name", F.lit(" met Big "), place, F.lit(" today")).alias("text"))


@query(f"""WITH {_CHUNK}, e AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+){{1,3}}\\b'))) AS name FROM chunk) SELECT lower(name) AS key, arg_min(name, chunk_id) AS name, 'CONCEPT' AS kind, COUNT(DISTINCT chunk_id) AS chunks, MIN(chunk_id) AS first FROM e GROUP BY lower(name)""")
def default_entities(t: Tables):
    return A.entities(_chunks(t))


@query(f"WITH {_CHUNK} SELECT chunk_id, 'Big Blue House' AS subject, 'stands with' AS predicate, 'New Yorker' AS object FROM chunk WHERE chunk_id % 2 = 0")
def default_triples(t: Tables):
    return A.triples_of(_chunks(t))


@query(r"""SELECT item_id, substr(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')[1:2], ' '), 1, 300) AS summary FROM benchmark""")
def default_summaries(t: Tables):
    return t.benchmark.select("item_id", A.summary(F.col("text")).alias("summary"))


_TURN = "turn AS (SELECT conv_id AS query_id, FIRST_VALUE(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query, turn AS id, text FROM conversations)"
_SCORE = f"CASE WHEN len({_W.format('query')}) > 0 THEN round(len(list_intersect({_W.format('query')}, {_W.format('text')})) / CAST(len({_W.format('query')}) AS DOUBLE), 6) ELSE 0 END"


def _turns(t: Tables):
    from pyspark.sql import Window

    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select(F.col("conv_id").alias("query_id"), first.alias("query"), F.col("turn").alias("id"), "text")


@query(f"WITH {_TURN}, s AS (SELECT *, {_SCORE} AS relevance FROM turn), r AS (SELECT query_id, id, relevance, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def reranked_passages(t: Tables):
    return A.reranked(_turns(t), 3)


@query(f"WITH {_TURN}, s AS (SELECT *, {_SCORE} >= 0.3 AS ok FROM turn), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM s) SELECT query_id, id FROM a WHERE ok OR NOT any_ok")
def relevance_filter(t: Tables):
    return A.relevant(_turns(t), 0.3).select("query_id", "id")


@query("WITH c AS (SELECT conv_id AS query_id, COUNT(*) AS parts, arg_min(text, turn) AS first, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id) SELECT query_id, CASE WHEN parts <= 2 THEN joined ELSE first END AS answer, parts FROM c")
def joined_answers(t: Tables):
    return A.answers(_turns(t))


@query("WITH b AS (SELECT conv_id AS query_id, text, SUM(length(text)) OVER w AS used, ROW_NUMBER() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY role, turn ROWS UNBOUNDED PRECEDING)) SELECT query_id, string_agg('[' || CAST(n AS VARCHAR) || '] ' || text, chr(10) ORDER BY n) AS prompt, COUNT(*) AS n FROM b WHERE used <= 1500 GROUP BY query_id")
def synthesis_prompts(t: Tables):
    return A.prompts(t.conversations.select(F.col("conv_id").alias("query_id"), F.col("role").alias("kind"), F.col("turn").alias("id"), "text"), 1500)


@query("SELECT conv_id AS query_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS number, turn AS id, substr(text, 1, 100) AS preview FROM conversations")
def citation_list(t: Tables):
    return A.citation_list(_turns(t).withColumn("score", F.length("text")))


@query("SELECT c_custkey AS question_id, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def evidence_counts(t: Tables):
    return A.evidence_counts(t.customer.select(F.col("c_custkey").alias("question_id")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("question_id")))


@query("SELECT s_suppkey AS doc_id, s_name AS subject, 'signed as' AS predicate, 'Director' AS object FROM supplier UNION ALL SELECT s_suppkey, s_name, 'signed on', '2024-01-0' || CAST(s_suppkey % 9 + 1 AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, s_name, 'is signatory', CAST(s_suppkey AS VARCHAR) FROM supplier")
def signature_triples(t: Tables):
    return A.signature_triples(t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.concat("s_name", F.lit(" / Director / 2024-01-0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit(" / ")).alias("text")))


@query("SELECT n_nationkey AS doc_id, x AS subject, 'signed on' AS predicate, '1/2/2024' AS object FROM nation, (VALUES ('Acme Trading Inc'), ('Zed Corp')) v(x) UNION ALL SELECT n_nationkey, 'Acme Trading Inc', 'co-signed with', 'Zed Corp' FROM nation")
def signature_block_triples(t: Tables):
    return A.block_triples(t.nation.select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("by Acme Trading Inc and Zed Corp on 1/2/2024 in "), F.lower("n_name")).alias("text")))


@query("SELECT p_partkey AS id, name FROM part, (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey < 10) WHERE contains(' ' || lower('the ' || p_name || ' of ' || p_brand) || ' ', ' ' || lower(name) || ' ')")
def entity_mentions_in_text(t: Tables):
    names = t.part.where("p_partkey < 10").select(F.col("p_name").alias("name")).distinct().withColumn("aliases", F.lit(None).cast("array<string>"))
    return A.mentioned(names, t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand").alias("text")))


@query(f"WITH {RELATIONS} SELECT p_size AS group_id, COUNT(DISTINCT src) AS entities, COUNT(*) AS relations, COUNT(DISTINCT src) >= 45 AND COUNT(*) >= 900 AS commit FROM rel JOIN part ON p_partkey = src GROUP BY p_size")
def commit_gates(t: Tables):
    r = X.relations(t).join(t.part, F.col("p_partkey") == F.col("src")).groupBy(F.col("p_size").alias("group_id")).agg(F.countDistinct("src").alias("entities"), F.count(F.lit(1)).alias("relations"))
    return A.commit_gate(r, 45, 900)


@query("SELECT p_partkey, round(0.7 * (1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) / 2.0 + 0.3 * CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END, 2) AS confidence FROM part")
def extraction_confidence(t: Tables):
    size = F.col("p_size")
    found = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.when(size % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit("note"), F.when(size % 3 == 0, "x"))
    return t.part.select("p_partkey", A.confidence(found, ["name", "brand"], ["note"]).cast("double").alias("confidence"))


@query("SELECT * FROM (VALUES ('id', 'integer', true), ('party.name', 'string', true), ('party.role', 'string', false), ('lines[].amount', 'number', false), ('tags[]', 'string', false)) v(path, kind, required)")
def schema_fields(t: Tables):
    schema = {
        "required": ["id"],
        "properties": {
            "id": {"type": "integer"},
            "party": {"type": "object", "required": ["name"], "properties": {"name": {}, "role": {"type": "string"}}},
            "lines": {"type": "array", "items": {"type": "object", "properties": {"amount": {"type": "number"}}}},
            "tags": {"type": "array", "items": {"type": "string"}},
        },
    }
    return t.spark.createDataFrame(A.schema_fields(schema), "path string, kind string, required boolean")


@query("SELECT event_id, event_id % 4 NOT IN (1, 2) AS valid FROM events")
def schema_validation(t: Tables):
    js = F.when(F.col("event_id") % 4 == 1, '{"n": 1}').when(F.col("event_id") % 4 == 2, '{"k": ').otherwise(F.col("props"))
    return A.valid(t.events.select("event_id", js.alias("js")), "js", "k int", ["k"]).select("event_id", "valid")


@query("SELECT n_nationkey, 'price' AS field, '1' AS left, CAST(n_regionkey AS VARCHAR) AS right, 'DIFFERENT' AS verdict FROM nation UNION ALL SELECT n_nationkey, 'name', n_name, n_name, 'MATCH' FROM nation")
def comparison_results(t: Tables):
    text = F.concat(F.lit("Here is it:\n price | 1 | "), F.col("n_regionkey").cast("string"), F.lit(" | different\nname|"), F.col("n_name"), F.lit("|"), F.col("n_name"), F.lit("| MATCH \nno | line"))
    return t.nation.select("n_nationkey", F.explode(A.comparison_lines(text)).alias("r")).select("n_nationkey", "r.*")


def _worth(phrases: tuple[str, ...], worth: float) -> str:
    return " + ".join(f"CAST(contains(low, '{p}') AS INT) * {worth}" for p in phrases)


@query(rf"""WITH q AS (SELECT conv_id, turn, text, lower(text) AS low, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[2:] AS rest FROM conversations),
n AS (SELECT *, len(list_filter(rest, lambda x: regexp_matches(x, '(?s)^\p{{Lu}}.'))) AS proper FROM q)
SELECT conv_id, turn, CAST(round(GREATEST(LEAST({_worth(A.VAGUE, 0.15)} + {_worth(A.SCOPE, 0.2)} + {_worth(A.COMPARING, 0.2)} - CASE WHEN proper >= 2 THEN 0.3 WHEN proper = 1 THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(text, '["'']') THEN 0.2 ELSE 0 END, 1), 0), 6) AS DOUBLE) AS ambiguity,
  regexp_matches(text, '\S\s+[A-Z][a-z]') OR regexp_matches(text, '["''][^"'']{{2,}}["'']') OR regexp_matches(text, '\b[A-Z]{{2,}}-?\d+\b') AS explicit,
  len(list_filter(regexp_split_to_array(text, '(?i)\s+and\s+|;\s*|\?\s*'), lambda x: trim(x) <> '')) AS parts FROM n""")
def question_ambiguity(t: Tables):
    """Every turn of the conversations as a question."""
    q = F.col("text")
    return t.conversations.select("conv_id", "turn", A.ambiguity(q).cast("double").alias("ambiguity"), A.has_explicit_entity(q).alias("explicit"), F.size(A.parts_of(q)).alias("parts"))


@query("SELECT doc_id, 64 AS width, CASE WHEN regexp_matches(lower(text), '[a-z0-9$%]') THEN 1.0 ELSE 0.0 END AS norm FROM documents")
def default_embeddings(t: Tables):
    rows = A.embedded(t.documents.select("doc_id", "text"), F.col("text"))
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4)
    return rows.select("doc_id", F.size("embedding").alias("width"), norm.alias("norm"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 1, 2)")
def vectors_to_renew(t: Tables):
    k = F.col("doc_id") % 5
    vec = F.when(k == 0, F.lit(None).cast("array<double>")).when(k == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    text = F.when(k == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    rows = t.documents.select("doc_id", "text", vec.alias("embedding"), F.sha2(text, 256).alias("text_hash"))
    return A.stale_vectors(rows, 2, F.col("text")).select("doc_id")


@query("SELECT MIN(doc_id) AS doc_id, arg_min(source, doc_id) AS result FROM documents GROUP BY text HAVING MIN(doc_id) % 2 = 0")
def cached_extractions(t: Tables):
    """First copies of texts with even ids are in the cache."""
    first = t.documents.groupBy("text").agg(F.min(F.struct("doc_id", "source")).alias("f")).select(F.sha2("text", 256).alias("text_hash"), "f.doc_id", "f.source")
    cache = first.where("doc_id % 2 = 0").select("text_hash", F.col("source").alias("result"))
    return A.cached(first.select("doc_id", "text_hash"), cache)[0].select("doc_id", "result")


@query("SELECT p_partkey, regexp_full_match(p_name, 'red.*') AS whole, ROW_NUMBER() OVER (ORDER BY CASE WHEN p_size > 25 THEN p_size END DESC NULLS FIRST, p_partkey) AS place FROM part")
def match_and_null_order(t: Tables):
    """A pattern that must fit the whole text, and descending order with nulls first."""
    from ..operators.ranking import numbered

    rows = t.part.select("p_partkey", F.col("p_name").rlike("^(?:red.*)$").alias("whole"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("s"))
    return numbered(rows, [F.desc_nulls_first("s"), F.col("p_partkey")], name="place").select("p_partkey", "whole", "place")
