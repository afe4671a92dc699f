"""Graph patterns, aggregates, graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ranking as R
from . import fixture as X
from .fixture import BOTH, MENTIONS, RELATIONS, SENTENCES
from .registry import Tables, query


@query(f"""WITH {MENTIONS}, {RELATIONS},
deg AS (SELECT eid, COUNT(*) AS degree FROM (SELECT src AS eid FROM rel UNION ALL SELECT dst FROM rel) x GROUP BY eid),
chk AS (SELECT eid, COUNT(*) AS chunk_count FROM mention GROUP BY eid)
SELECT COALESCE(chk.eid, deg.eid) AS eid, COALESCE(degree, 0) AS degree, COALESCE(chunk_count, 0) AS chunk_count, ROUND(CAST(0.3 * COALESCE(degree, 0) + 0.7 * COALESCE(chunk_count, 0) AS DOUBLE), 6) AS importance
FROM chk FULL JOIN deg ON chk.eid = deg.eid""")
def entity_importance(t: Tables):
    return G.entity_importance(X.mentions(t), X.relations(t))


@query(f"""WITH {MENTIONS}, {RELATIONS} SELECT eid, COUNT(*) AS degree FROM (SELECT src AS eid FROM rel UNION ALL SELECT dst FROM rel) x GROUP BY eid ORDER BY degree DESC, eid LIMIT 10""")
def top_entities_by_degree(t: Tables):
    return G.entity_importance(X.mentions(t), X.relations(t)).orderBy(F.desc("degree"), "eid").limit(10).select("eid", "degree")


@query(f"""WITH {SENTENCES}, {MENTIONS} SELECT eid, section_id, COUNT(*) AS mentions FROM mention JOIN sent USING (sid) GROUP BY eid, section_id""")
def appears_in_section(t: Tables):
    return G.appears_in(X.mentions(t), X.sentences(t), "section_id")


@query(f"""WITH {SENTENCES}, {MENTIONS} SELECT eid, doc_id, COUNT(*) AS mention_count, COUNT(DISTINCT section_id) AS section_count FROM mention JOIN sent USING (sid) GROUP BY eid, doc_id""")
def documents_for_entities(t: Tables):
    return G.documents_of(X.mentions(t), X.sentences(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, per AS (SELECT section_id, eid, COUNT(*) AS mentions FROM mention JOIN sent USING (sid) GROUP BY section_id, eid)
SELECT * FROM (SELECT eid, section_id, mentions, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY mentions DESC, eid) AS rank FROM per) x WHERE rank <= 3""")
def hub_entities(t: Tables):
    return G.hubs(X.mentions(t), X.sentences(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, unit AS (SELECT DISTINCT eid, doc_id AS doc, section_id AS sec FROM mention JOIN sent USING (sid)),
u AS (SELECT * FROM unit)
SELECT a.doc AS doc_a, a.sec AS sec_a, b.doc AS doc_b, b.sec AS sec_b, COUNT(*) AS shared, ROUND(CAST(0.1 * COUNT(*) AS DOUBLE), 6) AS boost
FROM u a JOIN u b ON a.eid = b.eid AND a.doc < b.doc GROUP BY a.doc, a.sec, b.doc, b.sec HAVING COUNT(*) >= 2""")
def shares_entity(t: Tables):
    return G.shares_entity(X.mentions(t), X.sentences(t))


@query(f"""WITH {MENTIONS} SELECT a.eid AS a, b.eid AS b, COUNT(*) AS shared FROM mention a JOIN mention b ON a.sid = b.sid AND a.eid < b.eid GROUP BY a.eid, b.eid HAVING COUNT(*) >= 2""")
def co_mentions(t: Tables):
    return G.co_mentions(X.mentions(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, d AS (SELECT eid, doc_id, COUNT(*) AS m FROM mention JOIN sent USING (sid) GROUP BY eid, doc_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY doc_id) AS k FROM d)
SELECT eid, COUNT(*) AS doc_count, CAST(SUM(m) AS BIGINT) AS mentions, string_agg(CASE WHEN k <= 5 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS first_docs FROM r GROUP BY eid HAVING COUNT(*) >= 2""")
def entity_cross_document(t: Tables):
    return G.cross_document(X.mentions(t), X.sentences(t)).withColumn("first_docs", F.array_join(F.col("first_docs").cast("array<string>"), ","))


_SEEDS = "(1, 2, 3)"


@query(f"""WITH {RELATIONS}, {BOTH},
one AS (SELECT dst AS node, COUNT(*) AS paths FROM arc WHERE src IN {_SEEDS} AND dst NOT IN {_SEEDS} GROUP BY dst),
two AS (SELECT arc.dst AS node, CAST(SUM(one.paths) AS BIGINT) AS paths FROM one JOIN arc ON arc.src = one.node WHERE arc.dst NOT IN {_SEEDS} AND arc.dst NOT IN (SELECT node FROM one) GROUP BY arc.dst)
SELECT node, 1 AS distance, paths FROM one UNION ALL SELECT node, 2, paths FROM two""")
def expand_neighbours(t: Tables):
    return G.neighbours(X.relations(t), t.spark.range(1, 4).withColumnRenamed("id", "node"))


@query(f"""WITH {RELATIONS}, {BOTH}, top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY dst) AS r FROM arc),
zero AS (SELECT 1.0 AS score, CAST(n AS BIGINT) AS node FROM (VALUES (1), (2), (3)) v(n)),
one AS (SELECT dst AS node, score * 0.85 AS score FROM zero JOIN top ON src = node WHERE r <= 25),
two AS (SELECT dst AS node, score * 0.85 AS score FROM one JOIN top ON src = node WHERE r <= 10)
SELECT node, ROUND(SUM(CAST(score AS DOUBLE)), 6) AS score FROM (SELECT node, score FROM zero UNION ALL SELECT node, score FROM one UNION ALL SELECT node, score FROM two) x GROUP BY node""")
def decayed_spread(t: Tables):
    return G.decayed_spread(X.relations(t), t.spark.range(1, 4).withColumnRenamed("id", "node"))


_ROUNDS = 6
_PPR = f"""WITH {RELATIONS},
u AS (SELECT src, dst, SUM(w) AS w FROM (SELECT src, dst, w FROM rel UNION ALL SELECT dst, src, w FROM rel) x GROUP BY src, dst),
s AS (SELECT src, SUM(w) AS s FROM u GROUP BY src), p AS (SELECT u.src, u.dst, u.w / s.s AS p FROM u JOIN s ON u.src = s.src),
seed AS (SELECT CAST(n AS BIGINT) AS node, CAST(k AS DOUBLE) / 6 AS weight FROM (VALUES (1, 3), (2, 2), (3, 1)) v(n, k)), r0 AS (SELECT node, weight AS score FROM seed)"""
for _i in range(1, _ROUNDS + 1):
    _PPR += f""", r{_i} AS (SELECT node, SUM(score) AS score FROM (SELECT p.dst AS node, r.score * p.p * 0.5 AS score FROM r{_i - 1} r JOIN p ON p.src = r.node UNION ALL SELECT node, weight * 0.5 FROM seed) x GROUP BY node)"""
_PPR += f" SELECT node, ROUND(score, 6) AS score FROM r{_ROUNDS}"


@query(_PPR)
def personalized_pagerank(t: Tables):
    seeds = t.spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "node long, weight double")
    return G.pagerank(X.relations(t), seeds, rounds=_ROUNDS).withColumn("score", F.round("score", 6))


@query()
def personalized_pagerank_converged(t: Tables):
    """The same until the scores change by less than 1e-6 in sum."""
    seeds = t.spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "node long, weight double")
    return G.pagerank(X.relations(t), seeds).withColumn("score", F.round("score", 6))


@query(f"""WITH {SENTENCES}, {MENTIONS}, d AS (SELECT DISTINCT eid, doc_id FROM mention JOIN sent USING (sid) WHERE eid <= 5), n AS (SELECT eid, COUNT(*) AS n FROM d GROUP BY eid)
SELECT doc_id, ROUND(SUM(1.0 / n), 6) AS vote, COUNT(*) AS seeds FROM d JOIN n USING (eid) GROUP BY doc_id""")
def target_documents(t: Tables):
    return G.target_documents(X.mentions(t), X.sentences(t), t.spark.range(0, 6).withColumnRenamed("id", "eid"))


@query(f"""WITH {SENTENCES}, {MENTIONS}, seed AS (SELECT sid, ROUND(score / 1000000.0, 6) AS score, section_id FROM sent WHERE sid <= 10),
own AS (SELECT m.eid, seed.score AS s, seed.section_id AS sec FROM seed JOIN mention m USING (sid)),
found AS (SELECT m.sid, m.eid, own.s, own.sec, sent.section_id FROM own JOIN mention m ON m.eid = own.eid JOIN sent ON sent.sid = m.sid WHERE m.sid NOT IN (SELECT sid FROM seed))
SELECT sid, COUNT(DISTINCT eid) AS overlap, ROUND(MIN(s) * 0.8 * CASE WHEN MAX(CASE WHEN sec = section_id THEN 1 ELSE 0 END) = 1 THEN 1.3 ELSE 1.0 END, 6) AS score FROM found GROUP BY sid""")
def expand_by_entities(t: Tables):
    s = X.sentences(t)
    return G.expand_by_entities(X.mentions(t), s.where("sid <= 10").select("sid", F.round(F.col("score") / 1000000.0, 6).alias("score")), s)


@query("""WITH RECURSIVE tree AS (SELECT r_regionkey + 1000 AS id, CAST(0 AS BIGINT) AS parent FROM region UNION ALL SELECT n_nationkey, n_regionkey + 1000 FROM nation UNION ALL SELECT c_custkey + 10000, c_nationkey FROM customer),
down AS (SELECT CAST(id AS BIGINT) AS id, 0 AS depth FROM tree WHERE id = 1001 UNION ALL SELECT CAST(tree.id AS BIGINT), down.depth + 1 FROM tree JOIN down ON tree.parent = down.id)
SELECT id, depth FROM down""")
def folder_descendants(t: Tables):
    tree = t.region.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(0).cast("long").alias("parent"))
    tree = tree.unionAll(t.nation.select(F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + 1000).cast("long"))).unionAll(t.customer.select((F.col("c_custkey") + 10000).cast("long"), F.col("c_nationkey").cast("long")))
    return G.descendants(tree, F.lit(1001))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def unfiled_documents(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH iv AS (SELECT user_id AS doc_id, event_id AS id, epoch(ts) / 3600 AS h, value FROM events), a AS (SELECT doc_id, id, CAST(floor(h) AS BIGINT) AS s, CAST(floor(h) AS BIGINT) + 1 + id % 5 AS e FROM iv WHERE id % 2 = 0), b AS (SELECT doc_id, id, CAST(floor(h) AS BIGINT) AS s, CAST(floor(h) AS BIGINT) + 1 + id % 7 AS e FROM iv WHERE id % 2 = 1)
SELECT a.doc_id, a.id AS a_id, b.id AS b_id, LEAST(a.e, b.e) - GREATEST(a.s, b.s) AS overlap FROM a JOIN b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e""")
def interval_overlap(t: Tables):
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    ev = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), h.alias("start"))
    a = ev.where("id % 2 = 0").withColumn("end", F.col("start") + 1 + F.col("id") % 5)
    b = ev.where("id % 2 = 1").withColumn("end", F.col("start") + 1 + F.col("id") % 7)
    return G.overlapping(a, b, width=16)


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}
SELECT 'sentences' AS label, COUNT(*) AS n FROM sent UNION ALL SELECT 'mentions', COUNT(*) FROM mention UNION ALL SELECT 'relations', COUNT(*) FROM rel UNION ALL SELECT 'documents', COUNT(DISTINCT doc_id) FROM sent UNION ALL SELECT 'entities', COUNT(DISTINCT eid) FROM mention""")
def group_stats(t: Tables):
    s, m = X.sentences(t), X.mentions(t)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
    return one(s, "sentences").unionAll(one(m, "mentions")).unionAll(one(X.relations(t), "relations")).unionAll(one(s.select("doc_id").distinct(), "documents")).unionAll(one(m.select("eid").distinct(), "entities"))


@query(f"""WITH {SENTENCES}, {MENTIONS}, per AS (SELECT section_id, eid, COUNT(*) AS c FROM mention JOIN sent USING (sid) GROUP BY section_id, eid), best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY c DESC, section_id) AS r FROM per)
SELECT eid, section_id AS community FROM best WHERE r = 1""")
def community_of_entities(t: Tables):
    """Each entity's main section, as a stated community; peers and hierarchies start from it."""
    per = G.appears_in(X.mentions(t), X.sentences(t), "section_id")
    return R.top_per_group(per, ["eid"], [F.desc("mentions"), F.col("section_id")], 1).select("eid", F.col("section_id").alias("community"))


@query(f"""WITH {SENTENCES}, seed AS (SELECT section_id, COUNT(*) AS n, ROUND(SUM(score), 2) AS total FROM sent WHERE score > 200000 GROUP BY section_id HAVING COUNT(*) >= 2)
SELECT section_id, n, total FROM seed ORDER BY total DESC, section_id LIMIT 10""")
def structural_seeds(t: Tables):
    per = X.sentences(t).where("score > 200000").groupBy("section_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total")).where("n >= 2")
    return per.orderBy(F.desc("total"), "section_id").limit(10)
