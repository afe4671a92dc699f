"""Graphs, walks, seeds and the ranking of what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import fulltext as FT
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import seeds as S
from ..operators import vector as V
from . import fixture as X
from .context_queries import entities, hits, seeds
from .fixture import MENTIONS, RELATIONS, SENTENCES
from .more_queries import _MEMBERS, _members
from .registry import Tables, query

_SEED = "seed AS (SELECT p_partkey AS eid FROM part WHERE p_size = 1)"
_SIM = "sim AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"""WITH {MENTIONS}, {RELATIONS}, {_SIM}, p AS (SELECT LEAST(src, dst) AS x, GREATEST(src, dst) AS y, arg_min(w, src) AS w FROM rel GROUP BY 1, 2) SELECT 'e' || CAST(x AS VARCHAR) AS src, 'e' || CAST(y AS VARCHAR) AS dst, w FROM p UNION ALL SELECT 's' || CAST(sid AS VARCHAR), 'e' || CAST(eid AS VARCHAR), 1.0 FROM mention UNION ALL SELECT 's' || CAST(a AS VARCHAR), 's' || CAST(b AS VARCHAR), score FROM sim WHERE score >= 0.45""")
def weighted_graph(t: Tables):
    return G.weighted_graph(X.relations(t), X.mentions(t), V.similar_pairs(t.embeddings, 0.45), 0.45)


@query(f"WITH {_SIM} SELECT a, b, round(score / (1 + 0.2 * (b - a)), 6) AS w FROM sim WHERE score >= 0.4")
def near_sections(t: Tables):
    return G.near_sections(V.similar_pairs(t.embeddings, 0.4), t.embeddings.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ordinal")))


@query(f"WITH {RELATIONS}, {MENTIONS} SELECT src, dst, 1 AS kind FROM rel UNION ALL SELECT dst, src, 1 FROM rel UNION ALL SELECT 1000000 + sid, eid, 2 FROM mention UNION ALL SELECT eid, 1000000 + sid, 2 FROM mention")
def directed_adjacency(t: Tables):
    """Every edge in both directions, repeats kept."""
    r, m = X.relations(t), X.mentions(t)
    sid = F.col("sid") + 1000000
    return r.select("src", "dst", F.lit(1).alias("kind")).unionAll(r.select("dst", "src", F.lit(1))).unionAll(m.select(sid, "eid", F.lit(2))).unionAll(m.select("eid", sid, F.lit(2)))


@query(f"WITH {MENTIONS} SELECT a.eid AS src, b.eid AS dst, CAST(COUNT(*) AS DOUBLE) AS w FROM mention a JOIN mention b ON a.sid = b.sid AND a.eid < b.eid GROUP BY 1, 2")
def co_mention_fallback(t: Tables):
    """Without related entities the graph is made of common sentences."""
    return G.relations_or_co_mentions(X.relations(t).limit(0), X.mentions(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, z AS (SELECT p_partkey AS eid, CAST(p_size AS DOUBLE) AS weight FROM part WHERE p_partkey IN (3, 4, 5)), ats AS (SELECT DISTINCT eid, section_id FROM mention JOIN sent USING (sid)), own AS (SELECT z.eid, weight, section_id FROM z JOIN ats USING (eid)), b2 AS (SELECT src, dst FROM rel UNION SELECT dst, src FROM rel),
sim AS (SELECT n_nationkey AS section_id, (n_nationkey + 1) % 25 AS other, 0.5 AS score FROM nation), hc AS (SELECT section_id, eid, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY COUNT(*) DESC, eid) AS r FROM mention JOIN sent USING (sid) GROUP BY section_id, eid),
p AS (SELECT eid, weight AS s FROM z UNION ALL SELECT b2.dst, MAX(weight) * 0.85 FROM z JOIN b2 ON b2.src = z.eid WHERE b2.dst <> z.eid GROUP BY z.eid, b2.dst UNION ALL SELECT ats.eid, MAX(weight) * 0.85 * 0.85 FROM own JOIN ats USING (section_id) WHERE own.eid <> ats.eid GROUP BY own.eid, ats.eid
UNION ALL SELECT ats.eid, MAX(weight) * MAX(score * 0.85 * 0.85) FROM own JOIN sim USING (section_id) JOIN ats ON ats.section_id = sim.other WHERE own.eid <> ats.eid GROUP BY own.eid, ats.eid UNION ALL SELECT hc.eid, MAX(weight) * 0.85 * 0.85 * 0.85 FROM own JOIN hc USING (section_id) WHERE r <= 3 AND own.eid <> hc.eid GROUP BY own.eid, hc.eid)
SELECT eid, CAST(round(SUM(s), 6) AS DOUBLE) AS score FROM p GROUP BY eid""")
def five_paths(t: Tables):
    z = t.part.where(F.col("p_partkey").isin(3, 4, 5)).select(F.col("p_partkey").alias("eid"), F.col("p_size").cast("double").alias("weight"))
    key = F.col("n_nationkey").cast("long")
    similar = t.nation.select(key.alias("section_id"), ((key + 1) % 25).alias("other"), F.lit(0.5).alias("score"))
    return G.five_paths(z, X.relations(t), X.mentions(t), X.sentences(t), similar, G.hubs(X.mentions(t), X.sentences(t)))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {_MEMBERS}, n AS (SELECT node, community, 'p' || CAST(node AS VARCHAR) AS name, ROW_NUMBER() OVER (PARTITION BY community ORDER BY node) AS r FROM member), e AS (SELECT a.community, a.name || ' -> ' || b.name AS t, ROW_NUMBER() OVER (PARTITION BY a.community ORDER BY src, dst) AS r FROM rel JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.community = b.community AND a.r <= 20 AND b.r <= 20),
h AS (SELECT community, string_agg(t, '; ' ORDER BY r) AS relations FROM e WHERE r <= 20 GROUP BY community) SELECT community, string_agg(name, ', ' ORDER BY r) AS members, COALESCE(MAX(relations), '') AS relations FROM n LEFT JOIN h USING (community) WHERE r <= 20 GROUP BY community""")
def community_info(t: Tables):
    names = t.part.select(F.col("p_partkey").alias("node"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return C.described(_members(t), X.relations(t), names, 20)


@query("SELECT label, round(0.70 + 0.20 * label / 10.0, 4) AS damping FROM (SELECT DISTINCT label FROM embeddings)")
def damping_factors(t: Tables):
    labels = sorted(r["label"] for r in t.embeddings.select("label").distinct().collect())  # at most the ten of the table
    return t.spark.createDataFrame([(x, S.damping(x / 10)) for x in labels], "label int, damping double")


@query(f"""WITH {MENTIONS}, a AS (SELECT p_partkey AS node FROM part WHERE p_size = 1), b AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#7'), c AS (SELECT DISTINCT eid AS node FROM mention JOIN orders ON o_orderkey = sid WHERE o_totalprice > 490000),
u AS (SELECT node, 0.5 / COUNT(*) OVER () AS w, 'entity' AS tier FROM a UNION ALL SELECT node, 0.3 / COUNT(*) OVER (), 'structure' FROM b UNION ALL SELECT node, 0.2 / COUNT(*) OVER (), 'theme' FROM c) SELECT node, round(SUM(w), 9) AS weight, string_agg(tier, ',' ORDER BY tier) AS tiers FROM u GROUP BY node""")
def seed_tiers(t: Tables):
    return S.tiers(_sources(t))


def _sources(t: Tables):
    theme = X.mentions(t).join(t.orders.where("o_totalprice > 490000").select(F.col("o_orderkey").alias("sid")), "sid").select(F.col("eid").alias("node"))
    return {"entity": (seeds(t).select(F.col("eid").alias("node")), 0.5), "structure": (t.part.where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node")), 0.3), "theme": (theme, 0.2)}


@query(f"""WITH {MENTIONS}, u AS (SELECT p_partkey AS node, 'entity' AS s FROM part WHERE p_size = 1 UNION ALL SELECT p_partkey, 'structure' FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT DISTINCT eid, 'theme' FROM mention JOIN orders ON o_orderkey = sid WHERE o_totalprice > 490000) SELECT node, string_agg(s, ',' ORDER BY s) AS sources, COUNT(*) AS n FROM u GROUP BY node""")
def flat_seed_pool(t: Tables):
    return S.flat_pool({name: df for name, (df, _) in _sources(t).items()})


@query(f"""WITH {MENTIONS}, u AS (SELECT p_partkey AS node, 'entity' AS s FROM part WHERE p_size = 1 UNION ALL SELECT p_partkey, 'structure' FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT DISTINCT eid, 'theme' FROM mention JOIN orders ON o_orderkey = sid WHERE o_totalprice > 490000), p AS (SELECT node, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY node) SELECT sources, COUNT(*) AS nodes FROM p GROUP BY sources""")
def seed_overlaps(t: Tables):
    return S.pool_stats(S.flat_pool({name: df for name, (df, _) in _sources(t).items()}))


@query(f"""WITH {MENTIONS}, {RELATIONS}, f AS (SELECT src, dst, w + (src % 10) / 10.0 AS score FROM rel WHERE src IN (SELECT p_partkey FROM part WHERE p_size = 1)), s AS (SELECT src, dst, (score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()) AS score FROM f), c AS (SELECT eid, COUNT(*) AS n FROM mention GROUP BY eid),
e AS (SELECT unnest([src, dst]) AS node, score FROM s), w AS (SELECT node, round(AVG(score / COALESCE(n, 1)), 9) AS weight FROM e LEFT JOIN c ON c.eid = node GROUP BY node), h AS (SELECT o_orderkey AS node, round(o_totalprice / 1e6, 4) AS score FROM orders WHERE o_orderstatus = 'P'), p AS (SELECT node, round((score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()) * 0.05, 9) AS weight FROM h)
SELECT node, MAX(weight) AS weight FROM (SELECT * FROM w UNION ALL SELECT * FROM p) x GROUP BY node""")
def walk_seeds(t: Tables):
    """Facts and passages as seeds of one walk; a node keeps its strongest weight."""
    r = X.relations(t).join(seeds(t), F.col("src") == F.col("eid"), "left_semi").select("src", "dst", (F.col("w") + (F.col("src") % 10) / 10.0).alias("score"))
    return S.strongest(S.from_facts(r, X.mentions(t)), S.from_passages(hits(t).withColumnRenamed("sid", "node")))


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (0, 20)), s AS (SELECT query_id, label, MAX(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6)) AS score FROM embeddings, q GROUP BY query_id, label) SELECT * FROM s WHERE score >= 0.25")
def section_headings(t: Tables):
    """Sections (labels) whose best heading is at least 0.25 like a question."""
    queries = t.embeddings.where("vec_id in (0, 20)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = V.every(queries, t.embeddings, 0.25).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return found.groupBy("query_id", "label").agg(F.max("score").alias("score"))


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 20), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q) SELECT vec_id, score, ROW_NUMBER() OVER (ORDER BY score DESC, vec_id) AS rank FROM s")
def whole_corpus_ranking(t: Tables):
    """A search without a limit ranks every passage."""
    from ..operators.vector_index import VectorIndex

    rows = t.embeddings.select("vec_id", "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    queries = t.embeddings.where("vec_id = 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return VectorIndex(rows, 64).search(queries, 0).select("vec_id", "score", "rank")


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 20), s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT label, vec_id, score, rank FROM r WHERE rank <= 3")
def semantic_coverage(t: Tables):
    """The three passages of each document (label) that are most like a question."""
    q = t.embeddings.where("vec_id = 20").select(F.col("embedding").alias("q"))
    rows = t.embeddings.crossJoin(F.broadcast(q)).select("label", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one row
    return R.top_per_group(rows, ["label"], [F.desc("score"), F.col("vec_id")], 3).select("label", "vec_id", "score", "rank")


@query("SELECT term, doc_id, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS term FROM documents) x GROUP BY term, doc_id")
def postings(t: Tables):
    return t.documents.select("doc_id", F.explode(FT.terms(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 20), v AS (SELECT vec_id AS id, ROW_NUMBER() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) DESC, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 20), f AS (SELECT p_partkey AS id, ROW_NUMBER() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_name LIKE '%widget%' QUALIFY rank <= 20),
c AS (SELECT id, rank FROM v UNION ALL SELECT id, rank + 20 FROM f) SELECT id, round(SUM(1.0 / (60 + rank)) * (1 + 0.05 * (id % 3)), 6) AS score FROM c GROUP BY id""")
def entities_hybrid(t: Tables):
    """Vector and text hits as one list: ranks of the second go on where the first ends; a community's rank raises the sum."""
    queries = t.embeddings.where("vec_id = 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    v = V.top_k(queries, t.embeddings, 20).select(F.col("vec_id").alias("id"), "rank")
    f = t.part.where(F.col("p_name").contains("widget")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
    f = R.top_per_group(f.withColumn("g", F.lit(1)), ["g"], [F.desc("p_retailprice"), F.col("p_partkey")], 20).select(F.col("p_partkey").alias("id"), (F.col("rank") + 20).alias("rank"))
    both = v.unionAll(f).groupBy("id").agg(F.sum(1 / (60 + F.col("rank"))).alias("s"))
    return both.select("id", F.round(F.col("s") * (1 + 0.05 * (F.col("id") % 3)), 6).alias("score"))


@query(f"""WITH {SENTENCES}, a AS (SELECT sid, ROW_NUMBER() OVER (ORDER BY score DESC, sid) AS rank FROM sent QUALIFY rank <= 200), b AS (SELECT sid, ROW_NUMBER() OVER (ORDER BY score, sid) AS rank FROM sent WHERE section_id < 5 QUALIFY rank <= 200), s AS (SELECT sid, round(SUM(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY sid), r AS (SELECT s.sid, s.score, doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY s.score DESC, s.sid) AS r FROM s JOIN sent USING (sid)) SELECT sid, doc_id, score FROM r WHERE r <= 2 ORDER BY score DESC, sid LIMIT 50""")
def hybrid_stage(t: Tables):
    """Fused ranks, at most two passages a document."""
    s = X.sentences(t)
    first = lambda df, *order: R.top_per_group(df.orderBy(*order).limit(200).withColumn("g", F.lit(1)), ["g"], list(order), 200).select(F.col("sid").alias("id"), "rank")
    fused = R.rrf(first(s, F.desc("score"), F.col("sid")), first(s.where("section_id < 5"), F.col("score"), F.col("sid"))).select(F.col("id").alias("sid"), F.round("score", 6).alias("score"))
    rows = fused.join(s.select("sid", "doc_id"), "sid")
    return R.two_caps(rows, [F.desc("score"), F.col("sid")], [("doc_id", 2)], 50).select("sid", "doc_id", "score")
