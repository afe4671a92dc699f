"""Deletes, renames, collection, pages and sinks' checks over the document graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators.vector_index import VectorIndex
from . import fixture as X
from .fixture import MENTIONS, RELATIONS, SENTENCES
from .registry import Tables, query

_STATE = "state AS (SELECT sid, doc_id, s_nationkey % 4 = 1 AS deprecated FROM sent JOIN supplier ON s_suppkey = doc_id)"

# The values of a vector, each times its place and as a whole number of millionths, so that the sum is exact.
_VALUES = "CAST(list_sum(list_transform(embedding, lambda x, i: i * CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT)"


def _values(vector):
    return F.aggregate(F.transform(vector, lambda x, i: (i + 1) * F.round(x.cast("double") * 1000000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def _gone(t: Tables):
    return t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("doc_id"))


def _state(t: Tables):
    flag = t.supplier.select(F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") % 4 == 1).alias("deprecated"))
    return X.sentences(t).select("sid", "doc_id").join(flag, "doc_id")


@query(f"""WITH {SENTENCES}, {MENTIONS}, gone AS (SELECT s_suppkey AS doc_id FROM supplier WHERE s_nationkey = 3), kept AS (SELECT * FROM mention WHERE sid IN (SELECT sid FROM sent WHERE doc_id NOT IN (SELECT doc_id FROM gone)))
SELECT 'document' AS label, s_suppkey AS id FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'sentence', sid FROM sent WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'mention', sid * 100000 + eid FROM kept UNION ALL SELECT 'lost entity', eid FROM (SELECT DISTINCT eid FROM mention) WHERE eid NOT IN (SELECT eid FROM kept)""")
def hard_delete_document(t: Tables):
    out = L.without_documents(t.supplier.select(F.col("s_suppkey").alias("doc_id")), X.sentences(t), X.mentions(t), _gone(t))
    row = lambda df, label, c: df.select(F.lit(label).alias("label"), c.alias("id"))
    return row(out["documents"], "document", F.col("doc_id")).unionAll(row(out["sentences"], "sentence", F.col("sid"))).unionAll(row(out["mentions"], "mention", F.col("sid") * 100000 + F.col("eid"))).unionAll(row(out["entities"], "lost entity", F.col("eid")))


@query(f"WITH {SENTENCES} SELECT sid, doc_id FROM sent WHERE doc_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def document_chunks_deleted(t: Tables):
    return X.sentences(t).join(_gone(t), "doc_id", "left_anti").select("sid", "doc_id")


@query("SELECT CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS doc_id, CASE WHEN s_suppkey % 10 = 0 THEN s_name || ',' || CAST(s_suppkey AS VARCHAR) ELSE s_name END AS aliases FROM supplier")
def renamed_documents(t: Tables):
    names = t.supplier.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000000).alias("new"))
    out = L.renamed(t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.array("s_name").alias("aliases")), names)
    return out.select("doc_id", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {SENTENCES}, {_STATE} SELECT vec_id AS sid, CASE WHEN COALESCE(deprecated, false) THEN 0 ELSE len(embedding) END AS width, CASE WHEN NOT COALESCE(deprecated, false) THEN {_VALUES} END AS place_sum FROM embeddings LEFT JOIN state ON sid = vec_id")
def deprecated_vectors(t: Tables):
    out = L.without_dead_vectors(t.embeddings.select(F.col("vec_id").alias("sid"), "embedding"), _state(t))
    return out.select("sid", F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).alias("width"), _values(F.col("embedding")).alias("place_sum"))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {_STATE}, e AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders), dead AS (SELECT sid FROM state WHERE deprecated)
SELECT '1 entities' AS step, COUNT(*) AS touched FROM (SELECT DISTINCT eid FROM mention) x WHERE eid NOT IN (SELECT eid FROM mention WHERE sid IN (SELECT sid FROM state WHERE NOT deprecated)) UNION ALL SELECT '2 edges', COUNT(*) FROM (SELECT DISTINCT * FROM e WHERE src IN (SELECT sid FROM dead) OR dst IN (SELECT sid FROM dead)) UNION ALL SELECT '3 vectors', COUNT(*) FROM embeddings WHERE vec_id IN (SELECT sid FROM dead)""")
def garbage_collection(t: Tables):
    edges = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return L.collected(X.mentions(t), edges, t.embeddings.select(F.col("vec_id").alias("sid"), "embedding"), _state(t))


@query("SELECT 'customers' AS label, COUNT(*) FILTER (c_mktsegment = 'MACHINERY') AS deleted FROM customer UNION ALL SELECT 'parts', COUNT(*) FILTER (p_type = 'MACHINERY') FROM part UNION ALL SELECT 'customers kept', COUNT(*) FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def group_deleted(t: Tables):
    left, count = L.without_group({"customers": t.customer.withColumn("group_id", F.col("c_mktsegment")), "parts": t.part.withColumn("group_id", F.col("p_type"))}, "MACHINERY")
    return count.unionAll(left["customers"].agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("customers kept").alias("label"), "deleted"))


@query(f"WITH {SENTENCES} SELECT sid, doc_id, section_id FROM sent")
def entities_only_deleted(t: Tables):
    """Entities, mentions and communities go, documents and sentences stay."""
    out = L.without_documents(t.supplier.select(F.col("s_suppkey").alias("doc_id")), X.sentences(t), X.mentions(t).limit(0), t.supplier.select(F.col("s_suppkey").alias("doc_id")).limit(0))
    return out["sentences"].select("sid", "doc_id", "section_id")


_TREE = "tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 9 THEN p_partkey // 10 END AS parent FROM part)"


def _tree(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 9, F.floor(F.col("p_partkey") / 10)).alias("parent"))


@query(f"WITH RECURSIVE {_TREE}, d AS (SELECT id FROM tree WHERE id = 7 UNION ALL SELECT tree.id FROM tree JOIN d ON tree.parent = d.id) SELECT id, parent FROM tree WHERE id NOT IN (SELECT id FROM d)")
def folder_deleted(t: Tables):
    return L.without_folder(_tree(t), F.lit(7))


@query(f"WITH {_TREE} SELECT id, CASE WHEN parent = 12 THEN 1 ELSE parent END AS parent FROM tree WHERE id <> 12")
def folder_dissolved(t: Tables):
    return L.without_folder(_tree(t), F.lit(12), cascade=False)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 50")
def file_page(t: Tables):
    """The second page of a listing, found by the last row of the first."""
    rows = t.orders.select("o_orderkey", "o_orderdate")
    last = L.page(rows, "o_orderdate", "o_orderkey", 50).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).first()
    return L.page(rows, "o_orderdate", "o_orderkey", 50, (last["o_orderdate"], last["o_orderkey"]))


@query("SELECT user_id AS group_id FROM events GROUP BY user_id HAVING MAX(ts) FILTER (event_type <> 'view') > COALESCE(MAX(ts) FILTER (event_type = 'view'), TIMESTAMP '1970-01-01')")
def stale_groups(t: Tables):
    rows = t.events.select(F.col("user_id").alias("group_id"), "ts", "event_type")
    return L.stale_groups(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"))


@query("WITH o AS (SELECT DISTINCT l_partkey AS content_id, l_suppkey AS owner FROM lineitem), a AS (SELECT content_id FROM o GROUP BY content_id HAVING COUNT(*) = 1 AND MIN(owner) = 5) SELECT content_id, owner FROM o WHERE content_id NOT IN (SELECT content_id FROM a)")
def content_removed(t: Tables):
    return L.sole_owned(t.lineitem.select(F.col("l_partkey").alias("content_id"), F.col("l_suppkey").alias("owner")).distinct(), F.lit(5))


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
def unique_violations(t: Tables):
    return L.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(f"WITH {RELATIONS} SELECT src, dst, CASE WHEN w > 1 THEN 'many' ELSE 'RELATED_TO' END AS rel_type FROM rel")
def relation_types(t: Tables):
    """Edges without a type take their description, or the general one."""
    r = X.relations(t).withColumns({"rel_type": F.lit(None).cast("string"), "description": F.when(F.col("w") > 1, "many")})
    return r.select("src", "dst", F.coalesce("rel_type", "description", F.lit("RELATED_TO")).alias("rel_type"))


@query("SELECT n_nationkey AS community, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' new' ELSE n_name END AS title, COUNT(s_suppkey) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name UNION ALL SELECT 999, 'fresh', 0")
def upsert_communities(t: Tables):
    """Communities and their members: known ones take the new title, new ones are added."""
    from ..operators.resolve import upsert

    old = t.nation.select(F.col("n_nationkey").cast("long").alias("community"), F.col("n_name").alias("title"), F.lit(1).alias("version"))
    new = old.where("community % 2 = 0").select("community", F.concat("title", F.lit(" new")).alias("title"), F.lit(2).alias("version")).unionAll(t.spark.createDataFrame([(999, "fresh", 2)], "community long, title string, version int"))
    size = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("community")).agg(F.count(F.lit(1)).alias("members"))
    return upsert(old, new, ["community"], "version").join(size, "community", "left").fillna(0, ["members"]).select("community", "title", "members")


@query(f"WITH {RELATIONS} SELECT src, dst, COALESCE(len(embedding), 0) AS width, {_VALUES} AS place_sum FROM rel LEFT JOIN embeddings ON vec_id = src")
def triple_vectors(t: Tables):
    """Edges with the vectors that were made for them; the others have none."""
    made = t.embeddings.select(F.col("vec_id").alias("src"), "embedding")
    return X.relations(t).join(made, "src", "left").select("src", "dst", F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).alias("width"), _values(F.col("embedding")).alias("place_sum"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT 0 AS query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label <> 3) SELECT query_id, vec_id, score, ROW_NUMBER() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10")
def index_after_delete(t: Tables):
    rows = t.embeddings.select("vec_id", "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    width = rows.select(F.size("embedding")).first()[0]
    index, _ = VectorIndex(rows.where("vec_id % 2 = 0"), width).add(rows).delete({"label": "3"})
    return index.search(t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("WITH u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, CAST(SUM(CAST(ceil(value) AS BIGINT)) AS BIGINT) AS used FROM events GROUP BY 1, 2) SELECT user_id, month, used, GREATEST(500 - used, 0) AS remaining, used < 500 AS allowed FROM u")
def credit_limits(t: Tables):
    u = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(F.ceil("value")).alias("used"))
    return u.select("user_id", "month", "used", F.greatest(500 - F.col("used"), F.lit(0).cast("long")).alias("remaining"), (F.col("used") < 500).alias("allowed"))


@query("SELECT event_type, COUNT(*) AS n, ROUND(AVG(value), 4) AS mean, MAX(value) AS worst FROM events GROUP BY event_type")
def tracked_queries(t: Tables):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("worst"))
