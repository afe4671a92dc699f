"""Communities, cascades, chunks, citations and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import resolve as RS
from ..operators import similar as SM
from ..operators import vector as V
from ..sources import readers
from . import fixture as X
from .fixture import BOTH, MENTIONS, RELATIONS, SENTENCES
from .linking_queries import diverse
from .registry import SQL, Tables, query
from .search_queries import _PAIRS, _SCORED, _queries


@query(f"WITH {SENTENCES} SELECT CAST(n_nationkey AS BIGINT) AS section_id, COUNT(sid) AS total FROM nation LEFT JOIN sent ON section_id = n_nationkey GROUP BY n_nationkey")
def section_totals(t: Tables):
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("section_id"))
    return n.join(X.sentences(t).groupBy("section_id").agg(F.count(F.lit(1)).alias("total")), "section_id", "left").fillna(0, ["total"])


@query(f"WITH {SENTENCES} SELECT sid, CAST(section_id AS VARCHAR) || '-S' || CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, section_id ORDER BY idx) AS VARCHAR) AS hid FROM sent")
def hierarchical_ids(t: Tables):
    at = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("idx"))
    return X.sentences(t).select("sid", F.concat(F.col("section_id").cast("string"), F.lit("-S"), at.cast("string")).alias("hid"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def documents_by_date(t: Tables):
    return t.orders.where("o_orderdate is not null").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", F.to_date("o_orderdate").alias("d"))


@query("WITH s AS (SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations), g AS (SELECT *, GREATEST(1, SUM(CASE WHEN tokens >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS part FROM s) SELECT conv_id, CAST(part AS BIGINT) AS part, MIN(turn) AS first_turn, COUNT(*) AS turns, CAST(SUM(tokens) AS BIGINT) AS tokens FROM g GROUP BY conv_id, part")
def merged_tiny_sections(t: Tables):
    """A section under 40 tokens joins the one before it; leading ones join the next."""
    s = t.conversations.select("conv_id", "turn", F.floor(F.length("text") / 4).alias("tokens"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    part = F.greatest(F.lit(1), F.sum((F.col("tokens") >= 40).cast("int")).over(w)).cast("long")
    return s.withColumn("part", part).groupBy("conv_id", "part").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))


@query(r"SELECT item_id, mark, COUNT(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text || ' [1] seen [12a], [1].', '\[([0-9]+[a-z]?)\]', 1)) AS mark FROM benchmark) x GROUP BY item_id, mark")
def citations(t: Tables):
    text = F.concat("text", F.lit(" [1] seen [12a], [1]."))
    return t.benchmark.select("item_id", F.explode(F.regexp_extract_all(text, F.lit(r"\[([0-9]+[a-z]?)\]"), F.lit(1))).alias("mark")).groupBy("item_id", "mark").agg(F.count(F.lit(1)).alias("n"))


_MEMBERS = "member AS (SELECT eid AS node, section_id AS community FROM (SELECT eid, section_id, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY COUNT(*) DESC, section_id) AS r FROM mention JOIN sent USING (sid) GROUP BY eid, section_id) x WHERE r = 1)"
_DEGREE = "deg AS (SELECT src AS node, COUNT(*) AS degree FROM arc GROUP BY src)"


def _members(t: Tables):
    per = G.appears_in(X.mentions(t), X.sentences(t), "section_id")
    return R.top_per_group(per, ["eid"], [F.desc("mentions"), F.col("section_id")], 1).select(F.col("eid").alias("node"), F.col("section_id").alias("community"))


def _degree(t: Tables):
    r = X.relations(t)
    return r.select("src", "dst").unionAll(r.select("dst", "src")).distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {BOTH}, {_MEMBERS}, {_DEGREE}, r AS (SELECT member.*, COALESCE(CAST(degree AS DOUBLE), 0) AS score, ROW_NUMBER() OVER (PARTITION BY community ORDER BY COALESCE(degree, 0) DESC, member.node) AS r FROM member LEFT JOIN deg ON deg.node = member.node)
SELECT community, COUNT(*) AS size, ROUND(AVG(score), 6) AS rank, string_agg(CASE WHEN r <= 3 THEN CAST(node AS VARCHAR) END, ',' ORDER BY r) AS top FROM r GROUP BY community HAVING COUNT(*) >= 2""")
def materialised_communities(t: Tables):
    rank = _degree(t).select("node", F.col("degree").cast("double").alias("score"))
    return C.materialise(_members(t), rank).withColumn("top", F.array_join(F.col("top").cast("array<string>"), ","))


@query(f"""WITH {SENTENCES}, child AS (SELECT sid AS node, doc_id AS community FROM sent), met AS (SELECT c.community AS child, p.section_id AS parent, COUNT(*) AS m FROM child c JOIN sent p ON p.sid = c.node GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY child ORDER BY m DESC, parent) AS r, SUM(m) OVER (PARTITION BY child) AS n FROM met)
SELECT child, parent, ROUND(CAST(m AS DOUBLE) / n, 6) AS share FROM r WHERE r = 1""")
def community_parents(t: Tables):
    s = X.sentences(t)
    return C.parents(s.select(F.col("sid").alias("node"), F.col("doc_id").alias("community")), s.select(F.col("sid").alias("node"), F.col("section_id").alias("community")))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {BOTH}, {_MEMBERS}, {_DEGREE}, own AS (SELECT DISTINCT community FROM member WHERE node < 5), r AS (SELECT m.community, m.node, ROW_NUMBER() OVER (PARTITION BY m.community ORDER BY degree DESC, m.node) AS rank FROM member m JOIN deg ON deg.node = m.node WHERE m.community IN (SELECT community FROM own) AND m.node >= 5)
SELECT community, node, rank FROM r WHERE rank <= 5""")
def community_peers(t: Tables):
    return C.peers(_members(t), t.spark.range(5).withColumnRenamed("id", "node"), _degree(t))


@query()
def detected_communities(t: Tables):
    return C.label_propagation(X.relations(t))


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS id, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations)
SELECT b.role, b.id, MIN(a.id) AS first FROM w a JOIN w b ON a.role = b.role AND a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) >= 0.9 * len(b.w) AND len(b.w) >= 0.9 * len(a.w)
WHERE len(list_intersect(a.w, b.w)) >= 0.92 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY b.role, b.id""")
def near_repeated_passages(t: Tables):
    return SM.jaccard_repeats(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text"), "role")


@query(f"WITH RECURSIVE {_SCORED}, near AS (SELECT query_id, vec_id AS id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) x WHERE r <= 30), {diverse('near', 7)} SELECT query_id, id, position FROM chosen")
def mmr_selection(t: Tables):
    top = V.top_k(_queries(t), t.embeddings, 30).withColumnRenamed("vec_id", "id")
    return SM.mmr(top.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id"))


@query(f"""WITH {_PAIRS}, e AS (SELECT a AS src, b AS dst FROM pairs WHERE score >= 0.4), arc AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
near AS (SELECT a.vec_id AS node, ROUND(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS sim FROM embeddings a, embeddings b WHERE b.vec_id = 0),
f0 AS (SELECT * FROM near ORDER BY sim DESC, node LIMIT 5), f1 AS (SELECT DISTINCT n.node, n.sim FROM arc JOIN f0 ON arc.src = f0.node JOIN near n ON n.node = arc.dst ORDER BY n.sim DESC, n.node LIMIT 5), f2 AS (SELECT DISTINCT n.node, n.sim FROM arc JOIN f1 ON arc.src = f1.node JOIN near n ON n.node = arc.dst ORDER BY n.sim DESC, n.node LIMIT 5)
SELECT node, ROUND(SUM(s), 6) AS score FROM (SELECT node, sim * 0.9 AS s FROM f0 UNION ALL SELECT node, sim * 0.85 FROM f1 UNION ALL SELECT node, sim * 0.85 * 0.85 FROM f2) x GROUP BY node""")
def semantic_beam(t: Tables):
    edges = V.similar_pairs(t.embeddings, 0.4).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return SM.beam(edges, t.embeddings, _queries(t).where("query_id = 0"))


@query(f"""WITH {SENTENCES}, {MENTIONS}, d AS (SELECT doc_id, eid, COUNT(*) AS m FROM mention JOIN sent USING (sid) GROUP BY doc_id, eid), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY m DESC, eid) AS rank FROM d), k AS (SELECT doc_id, eid, rank FROM r WHERE rank <= 2)
SELECT doc_id, eid, ROW_NUMBER() OVER (ORDER BY rank, doc_id) AS position FROM k ORDER BY rank, doc_id LIMIT 30""")
def entities_by_document_turn(t: Tables):
    per = G.documents_of(X.mentions(t), X.sentences(t))
    return R.round_robin(per, "doc_id", [F.desc("mention_count"), F.col("eid")], 2, 30).select("doc_id", "eid", "position")


@query("""WITH seed AS (SELECT n_name AS seed, lower(n_name) AS k FROM nation UNION SELECT substr(n_name, 3), lower(substr(n_name, 3)) FROM nation), name AS (SELECT DISTINCT r_name AS name, lower(r_name) AS k FROM region UNION SELECT n_name, lower(n_name) FROM nation),
s1 AS (SELECT seed, name, 1 AS step FROM seed JOIN name ON seed.k = name.k), s2 AS (SELECT seed, name, 2 AS step FROM seed JOIN name ON contains(name.k, seed.k) OR contains(seed.k, name.k) WHERE seed NOT IN (SELECT seed FROM s1))
SELECT * FROM s1 UNION ALL SELECT * FROM s2""")
def seed_cascade(t: Tables):
    """Seeds match names exactly, and only those left match by substring, either way; the seed set is a stated, small one."""
    seeds = t.nation.select(F.explode(F.array("n_name", F.substring("n_name", 3, 1 << 20))).alias("seed")).distinct().withColumn("sk", F.lower("seed"))
    names = t.region.select(F.col("r_name").alias("name")).unionAll(t.nation.select("n_name")).distinct().withColumn("nk", F.lower("name"))
    exact = names.join(F.broadcast(seeds), F.col("nk") == F.col("sk")).select("seed", "name", F.lit(1).alias("step"))
    left = seeds.join(exact, "seed", "left_anti")
    part = names.join(F.broadcast(left), F.contains("nk", "sk") | F.contains("sk", "nk")).select("seed", "name", F.lit(2).alias("step"))
    return exact.unionAll(part)


@query(f"WITH {RELATIONS}, named AS (SELECT p_partkey FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'bolt')) SELECT src, dst, w FROM rel WHERE src IN (FROM named) AND dst IN (FROM named)")
def evidence_subgraph(t: Tables):
    """Relations between the parts that a keyword names."""
    nodes = t.part.where(F.contains("p_name", F.lit("red")) | F.contains("p_name", F.lit("bolt"))).select("p_partkey")
    return X.relations(t).join(nodes, F.col("src") == F.col("p_partkey"), "left_semi").join(nodes, F.col("dst") == F.col("p_partkey"), "left_semi")


@query(f"WITH {RELATIONS}, {BOTH}, {_DEGREE} SELECT p_partkey AS node, degree FROM part JOIN deg ON node = p_partkey WHERE contains(lower(p_name), 'a') OR contains(lower(p_name), 'blue') ORDER BY degree DESC, p_partkey LIMIT 10")
def hubs_by_keyword(t: Tables):
    named = t.part.where(F.contains(F.lower("p_name"), F.lit("a")) | F.contains(F.lower("p_name"), F.lit("blue")))
    return named.join(_degree(t), F.col("p_partkey") == F.col("node")).select("node", "degree").orderBy(F.desc("degree"), "node").limit(10)


@query(f"WITH {MENTIONS} SELECT eid, COUNT(*) AS n, md5(string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid)) AS listed FROM mention GROUP BY eid")
def inverted_index(t: Tables):
    """The whole list of sentences of each entity, put together from lists of 100,000 numbers each, so that a hot entity is sorted by many tasks."""
    ids = F.sort_array(F.collect_list("sid"))
    parts = X.mentions(t).groupBy("eid", F.floor(F.col("sid") / 100_000).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.nullif(F.array_join(ids.cast("array<string>"), ","), F.lit("")).alias("ids"))
    whole = F.nullif(F.array_join(F.sort_array(F.collect_list(F.struct("block", "ids")))["ids"], ","), F.lit(""))
    return parts.groupBy("eid").agg(F.sum("n").alias("n"), F.md5(whole).alias("listed"))


@query("WITH g AS (SELECT source, lang, SUM(n_chars) AS n FROM documents GROUP BY source, lang), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM g) SELECT source, lang FROM r WHERE r = 1")
def dominant_languages(t: Tables):
    g = t.documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("n"))
    return R.top_per_group(g, ["source"], [F.desc("n"), F.col("lang")], 1).select("source", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR length(text) % 2 = 1")
def changed_documents(t: Tables):
    """Rows whose content digest is not the one known from the last run; every third document was known, and of those the ones of odd length have changed since."""
    now = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    odd = F.length("text") % 2 == 1
    known = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("path"), F.md5(F.when(odd, F.concat("text", F.lit("old"))).otherwise(F.col("text"))).alias("md5"))
    return readers.changed_files(now, known).select(F.col("path").alias("doc_id"))


@query("SELECT md5(text) AS digest, MIN(doc_id) AS first, COUNT(*) AS copies FROM documents GROUP BY 1 HAVING COUNT(*) > 1")
def exact_copies(t: Tables):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(f"""WITH {SENTENCES}, covered AS (SELECT DISTINCT doc_id FROM sent WHERE score > 400000), r AS (SELECT sid, doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS r FROM sent WHERE doc_id NOT IN (SELECT doc_id FROM covered)) SELECT sid, doc_id FROM r WHERE r = 1""")
def coverage_gaps(t: Tables):
    """The best sentence of every document that no strong hit covers."""
    s = X.sentences(t)
    rest = s.join(s.where("score > 400000").select("doc_id").distinct(), "doc_id", "left_anti")
    return R.top_per_group(rest, ["doc_id"], [F.desc("score"), F.col("sid")], 1).select("sid", "doc_id")


def _seed_weights(mentions: DataFrame, d: DataFrame) -> DataFrame:
    """Entity seeds weigh one over their mentions, passage seeds a twentieth of their scaled score."""
    c = mentions.groupBy("eid").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("e"), F.col("eid").cast("string")).alias("node"), F.round(1.0 / F.col("n"), 6).alias("weight"))
    e = d.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return c.unionAll(d.crossJoin(F.broadcast(e)).select(F.concat(F.lit("s"), F.col("sid").cast("string")), F.round(0.05 * (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6)))


@query("SELECT event_id, user_id, ts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) x WHERE r <= 20")
def latest_usage(t: Tables):
    return R.top_per_group(t.events, ["user_id"], [F.desc("ts"), F.col("event_id")], 20).select("event_id", "user_id", "ts")


@query("SELECT event_type, user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type IN ('click', 'view') GROUP BY event_type, user_id")
def usage_range(t: Tables):
    e = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' and ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").where(F.col("event_type").isin("click", "view"))
    return e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _moved(documents: DataFrame) -> DataFrame:
    """A move replaces the folder only where the caller's version is the current one; stale moves (odd ids) change nothing."""
    now = documents.select("doc_id", F.col("source").alias("folder"), F.lit(1).alias("version"))
    moves = now.select(F.col("doc_id").alias("m"), F.lit("moved").alias("to"), (1 - F.col("doc_id") % 2).alias("expected"))
    hit = (F.col("expected") == F.col("version"))
    return now.join(moves, F.col("doc_id") == F.col("m"), "left").select("doc_id", F.when(hit, F.col("to")).otherwise(F.col("folder")).alias("folder"), F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


@query(f"""WITH {SENTENCES}, {MENTIONS}, q AS (SELECT section_id, COUNT(DISTINCT eid) AS d, COUNT(*) AS n, COUNT(DISTINCT sid) AS s FROM mention JOIN sent USING (sid) GROUP BY section_id), h AS (SELECT section_id, MAX(c) AS top FROM (SELECT section_id, eid, COUNT(*) AS c FROM mention JOIN sent USING (sid) GROUP BY section_id, eid) x GROUP BY section_id)
SELECT q.section_id, ROUND(0.6 * CASE WHEN s >= 2 THEN 1 ELSE 0 END + 0.4 * CAST(d AS DOUBLE) / n - LEAST(0.2, CASE WHEN 2 * top > n THEN 0.05 ELSE 0 END), 6) AS confidence FROM q JOIN h USING (section_id)""")
def evidence_confidence(t: Tables):
    """0.6 for two pieces of evidence, 0.4 times distinct over all entities, less 0.05 where one entity makes over half."""
    per = G.appears_in(X.mentions(t), X.sentences(t), "section_id").groupBy("section_id").agg(F.count(F.lit(1)).alias("d"), F.sum("mentions").alias("n"), F.max("mentions").alias("top"))
    s = X.mentions(t).select("sid").distinct().join(X.sentences(t), "sid").groupBy("section_id").agg(F.count(F.lit(1)).alias("s"))
    c = 0.6 * (F.col("s") >= 2).cast("double") + 0.4 * F.col("d") / F.col("n") - F.when(2 * F.col("top") > F.col("n"), 0.05).otherwise(0.0)
    return per.join(s, "section_id").select("section_id", F.round(c, 6).alias("confidence"))


# Three queries with two names each: both run over whole tables.


@query("WITH s AS (SELECT DISTINCT p_name AS seed, string_split(lower(p_name), ' ') AS w FROM part WHERE p_partkey <= 20), n AS (SELECT DISTINCT p_name AS name, string_split(lower(p_name), ' ') AS w FROM part), x AS (SELECT DISTINCT seed, unnest(w) AS w FROM s), y AS (SELECT DISTINCT name, unnest(w) AS w FROM n) SELECT seed, name, COUNT(*) AS shared FROM x JOIN y USING (w) WHERE length(w) >= 3 GROUP BY seed, name")
def token_overlap_all_parts(t: Tables):
    """A stated seed set against every part, the seeds' own among them."""
    s = t.part.where("p_partkey <= 20").select(F.col("p_name").alias("seed")).distinct()
    return RS.token_overlap(s, t.part.select(F.col("p_name").alias("name")).distinct())


@query(f"""WITH {SENTENCES}, {MENTIONS}, c AS (SELECT eid, COUNT(*) AS n FROM mention GROUP BY eid), e AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM sent)
SELECT 'e' || CAST(eid AS VARCHAR) AS node, ROUND(1.0 / n, 6) AS weight FROM c UNION ALL SELECT 's' || CAST(sid AS VARCHAR), ROUND(0.05 * (score - lo) / (hi - lo), 6) FROM sent, e""")
def all_seed_weights(t: Tables):
    return _seed_weights(X.mentions(t), X.sentences(t).select("sid", "score"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE source END AS folder, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def all_moved_documents(t: Tables):
    return _moved(t.documents)


for _old, _new in (("token_overlap_seeds", token_overlap_all_parts), ("seed_weights", all_seed_weights), ("moved_documents", all_moved_documents)):
    query(SQL[_new.__name__], name=_old)(_new)
