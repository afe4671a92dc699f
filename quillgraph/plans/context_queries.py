"""Scans, joins and passages around entities. A part is an entity: its name, type and brand are name, kind and description."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as K
from ..operators import graph as G
from ..operators.ranking import top_per_group, two_caps
from . import fixture as X
from .fixture import BOTH, MENTIONS, RELATIONS, SENTENCES
from .more_queries import _MEMBERS, _members
from .registry import Tables, query

_SEEDS = 40


def entities(t: Tables):
    return t.part.select(F.col("p_partkey").alias("eid"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("description"))


def seeds(t: Tables):
    """A stated set: the parts of size 1."""
    return t.part.where("p_size = 1").select(F.col("p_partkey").alias("eid"))


def edges(t: Tables):
    """Edges with a description on those whose ends' numbers sum to no multiple of 5."""
    r = X.relations(t)
    return r.withColumn("description", F.when((F.col("src") + F.col("dst")) % 5 != 0, F.concat(F.lit("with "), F.col("w").cast("int").cast("string"))))


_SEED = "seed AS (SELECT p_partkey AS eid FROM part WHERE p_size = 1)"
_EDGE = "edge AS (SELECT src, dst, w, CASE WHEN (src + dst) % 5 <> 0 THEN 'with ' || CAST(CAST(w AS INT) AS VARCHAR) END AS description FROM rel)"
_DOCS = "docs AS (SELECT DISTINCT eid, doc_id FROM mention JOIN sent USING (sid))"


@query("SELECT p_partkey AS eid, p_name AS name, p_type AS kind, p_brand AS description FROM part WHERE p_type IN ('ECONOMY', '__global__')")
def entity_scan(t: Tables):
    from ..operators.scope import tenant

    return tenant(entities(t), "ECONOMY", "kind")


@query(f"WITH {RELATIONS}, {_EDGE} SELECT src, dst, s.p_name || ' | ' || description || ' | ' || o.p_name AS triple FROM edge JOIN part s ON s.p_partkey = src JOIN part o ON o.p_partkey = dst WHERE description IS NOT NULL")
def triple_scan(t: Tables):
    return K.triples(edges(t), entities(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {_DOCS}, b AS (SELECT src, dst, MIN(x.doc_id) AS d FROM rel JOIN docs x ON x.eid = src JOIN docs y ON y.eid = dst AND y.doc_id = x.doc_id GROUP BY src, dst), f AS (SELECT eid, MIN(doc_id) AS d FROM docs GROUP BY eid)
SELECT rel.src, rel.dst, COALESCE(b.d, f.d) AS doc_id FROM rel LEFT JOIN b ON b.src = rel.src AND b.dst = rel.dst LEFT JOIN f ON f.eid = rel.src""")
def triple_documents(t: Tables):
    return K.triple_documents(X.relations(t), G.documents_of(X.mentions(t), X.sentences(t)).select("eid", "doc_id"))


@query(f"WITH {SENTENCES} SELECT sid, doc_id, idx FROM sent ORDER BY doc_id, idx")
def sentences_in_order(t: Tables):
    return X.sentences(t).select("sid", "doc_id", "idx").orderBy("doc_id", "idx")


@query("SELECT o_orderkey AS sid, o_totalprice AS score FROM orders ORDER BY o_orderkey LIMIT 500")
def first_chunks(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("sid"), F.col("o_totalprice").alias("score")).orderBy("sid").limit(500)


@query(f"WITH {SENTENCES} SELECT doc_id, s_name AS title, COUNT(*) AS sentences, COUNT(DISTINCT section_id) AS sections, MAX(score) AS top FROM sent JOIN supplier ON s_suppkey = doc_id GROUP BY doc_id, s_name ORDER BY doc_id LIMIT 50")
def document_overviews(t: Tables):
    per = X.sentences(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct("section_id").alias("sections"), F.max("score").alias("top"))
    return per.join(t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title")), "doc_id").select("doc_id", "title", "sentences", "sections", "top").orderBy("doc_id").limit(50)


@query(f"WITH {RELATIONS}, {_SEED} SELECT src AS eid, dst AS other, true AS out, w FROM rel WHERE src IN (SELECT eid FROM seed) UNION ALL SELECT dst, src, false, w FROM rel WHERE dst IN (SELECT eid FROM seed)")
def entity_relations(t: Tables):
    return K.relations_of(X.relations(t), seeds(t))


@query("SELECT p_name AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS descriptions FROM part WHERE p_name IN ('red widget', 'small ring') GROUP BY p_name")
def entity_descriptions(t: Tables):
    wanted = t.spark.createDataFrame([("red widget",), ("small ring",), ("no such thing",)], "name string")
    return entities(t).join(wanted, "name").groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("description")), ",").alias("descriptions"))


_NAMES = ("Red  Widget!", "small", "Brand#7", "tiny red widget indeed", "widget or ring", "nothing here")
_KEY = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_& ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH seed AS (SELECT unnest({list(_NAMES)!r}) AS seed), s0 AS (SELECT seed, {_KEY.format("seed")} AS k FROM seed), name AS (SELECT DISTINCT p_name AS name, {_KEY.format("p_name")} AS k FROM part), field AS (SELECT DISTINCT {_KEY.format("p_brand")} AS k, p_name AS name FROM part),
f1 AS (SELECT seed, name FROM s0 JOIN name USING (k)), r1 AS (SELECT * FROM s0 WHERE seed NOT IN (SELECT seed FROM f1)), f2 AS (SELECT seed, name FROM r1 JOIN field USING (k)), r2 AS (SELECT * FROM r1 WHERE seed NOT IN (SELECT seed FROM f2)),
f3 AS (SELECT seed, name FROM (SELECT seed, name, ROW_NUMBER() OVER (PARTITION BY seed ORDER BY name) AS r FROM r2 JOIN name ON contains(' ' || name.k || ' ', ' ' || r2.k || ' ') OR contains(' ' || r2.k || ' ', ' ' || name.k || ' ')) x WHERE r <= 10), r3 AS (SELECT * FROM r2 WHERE seed NOT IN (SELECT seed FROM f3)),
f4 AS (SELECT seed, name FROM (SELECT seed, name, ROW_NUMBER() OVER (PARTITION BY seed ORDER BY COUNT(*) DESC, name) AS r FROM (SELECT DISTINCT seed, unnest(string_split(k, ' ')) AS w FROM r3) a JOIN (SELECT DISTINCT name, unnest(string_split(k, ' ')) AS w FROM name) b USING (w) WHERE length(w) >= 3 GROUP BY seed, name) x WHERE r <= 10)
SELECT *, 1 AS step FROM f1 UNION ALL SELECT *, 2 FROM f2 UNION ALL SELECT *, 3 FROM f3 UNION ALL SELECT *, 4 FROM f4""")
def entities_by_names(t: Tables):
    wanted = t.spark.createDataFrame([(n,) for n in _NAMES], "seed string")
    return K.by_names(wanted, t.part.select(F.col("p_name").alias("name")), t.part.select(F.col("p_brand").alias("key"), F.col("p_name").alias("name")))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {BOTH}, deg AS (SELECT src AS eid, COUNT(*) AS degree FROM arc GROUP BY src), r AS (SELECT sid, m.eid, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY COALESCE(degree, 0) DESC, m.eid) AS rank FROM mention m LEFT JOIN deg USING (eid)) SELECT sid, eid, rank FROM r WHERE rank <= 2""")
def entities_of_sentences(t: Tables):
    r = X.relations(t)
    both = r.select("src", "dst").union(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return K.of_sentences(X.mentions(t), both.groupBy(F.col("src").alias("eid")).agg(F.count(F.lit(1)).alias("degree")), X.sentences(t).select("sid"), 2)


@query(f"""WITH {SENTENCES}, {MENTIONS}, {_SEED}, own AS (SELECT * FROM mention WHERE eid IN (SELECT eid FROM seed)), sec AS (SELECT DISTINCT eid, doc_id, section_id FROM own JOIN sent USING (sid)), w AS (SELECT sec.eid, sent.sid, CASE WHEN own.sid IS NULL THEN 0.5 ELSE 1.0 END AS weight FROM sec JOIN sent USING (doc_id, section_id) LEFT JOIN own ON own.eid = sec.eid AND own.sid = sent.sid),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY weight DESC, sid) AS r FROM w) SELECT eid, sid, CAST(weight AS DOUBLE) AS weight FROM r WHERE r <= 10""")
def chunks_of_sections(t: Tables):
    return K.chunks_of_sections(seeds(t), X.mentions(t), X.sentences(t))


@query(f"WITH {SENTENCES}, {MENTIONS}, {_SEED} SELECT eid, sid, doc_id, section_id FROM mention LEFT JOIN sent USING (sid) WHERE eid IN (SELECT eid FROM seed)")
def chunks_of_mentions(t: Tables):
    return K.chunks_of_mentions(seeds(t), X.mentions(t), X.sentences(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid, doc_id, section_id ORDER BY idx, sid) AS r1 FROM mention JOIN sent USING (sid)), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid, doc_id ORDER BY idx, sid) AS r2 FROM a WHERE r1 <= 1), c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY doc_id, idx, sid) AS rank FROM b WHERE r2 <= 2) SELECT eid, sid, rank FROM c WHERE rank <= 5""")
def capped_chunks(t: Tables):
    return K.capped_chunks(X.mentions(t).join(X.sentences(t), "sid"), 5, 1, 2).select("eid", "sid", "rank")


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {_SEED}, own AS (SELECT eid, sid, doc_id, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY sid) AS r FROM mention LEFT JOIN sent USING (sid) WHERE eid IN (SELECT eid FROM seed)), c AS (SELECT eid, string_agg(CASE WHEN r <= 3 THEN CAST(sid AS VARCHAR) END, ',' ORDER BY sid) AS chunks, COUNT(DISTINCT doc_id) AS documents FROM own GROUP BY eid),
e AS (SELECT src AS eid, dst AS other, true AS o, w FROM rel UNION ALL SELECT dst, src, false, w FROM rel), q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY w DESC, other, o) AS r FROM e WHERE eid IN (SELECT eid FROM seed)), g AS (SELECT eid, string_agg(CAST(other AS VARCHAR), ',' ORDER BY r) AS relations FROM q WHERE r <= 3 GROUP BY eid)
SELECT eid, p_name AS name, p_brand AS description, COALESCE(chunks, '') AS chunks, COALESCE(documents, 0) AS documents, COALESCE(relations, '') AS relations FROM seed JOIN part ON p_partkey = eid LEFT JOIN c USING (eid) LEFT JOIN g USING (eid)""")
def full_context(t: Tables):
    out = K.full_context(seeds(t), entities(t).drop("kind"), X.mentions(t), X.sentences(t), X.relations(t))
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("eid", "name", "description", flat("chunks"), "documents", flat("relations"))


_HITS = "hit AS (SELECT o_orderkey AS sid, round(o_totalprice / 1e6, 4) AS score FROM orders WHERE o_orderstatus = 'P')"


def hits(t: Tables):
    return t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sid"), F.round(F.col("o_totalprice") / 1e6, 4).alias("score"))


@query(f"""WITH {SENTENCES}, {_HITS}, p AS (SELECT sid, LAG(sid) OVER w AS a, LEAD(sid) OVER w AS b FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT sid, score, concat_ws(' ', 's' || CAST(a AS VARCHAR), 's' || CAST(sid AS VARCHAR), 's' || CAST(b AS VARCHAR)) AS passage FROM p JOIN hit USING (sid)""")
def sentence_evidence(t: Tables):
    rows = X.sentences(t).withColumn("text", F.concat(F.lit("s"), F.col("sid").cast("string")))
    return K.stitched(hits(t).unionAll(hits(t).withColumn("score", F.lit(0.0))), rows)


@query(f"""WITH {SENTENCES}, hit AS (SELECT o_orderkey AS sid, round(o_totalprice / 6e5, 4) AS score FROM orders WHERE o_orderstatus = 'P'), z AS (SELECT * FROM hit WHERE score >= 0.45), rr AS (SELECT o_orderkey AS src, o_custkey AS dst, 0.5 AS sim FROM orders), bb AS (SELECT * FROM rr UNION ALL SELECT dst, src, sim FROM rr),
o AS (SELECT bb.dst AS sid, z.score * sim * CASE WHEN a.doc_id = b.doc_id AND a.section_id = b.section_id THEN 0.85 ELSE 0.6 END AS score FROM z JOIN bb ON bb.src = z.sid JOIN sent a ON a.sid = z.sid JOIN sent b ON b.sid = bb.dst),
n AS (SELECT sid, unnest([LAG(sid) OVER w, LEAD(sid) OVER w, LAG(sid, 2) OVER w, LEAD(sid, 2) OVER w]) AS near FROM sent WINDOW w AS (PARTITION BY doc_id, section_id ORDER BY idx, sid)),
u AS (SELECT sid, score FROM z UNION ALL SELECT * FROM o UNION ALL SELECT near, score * 0.9 FROM n JOIN z USING (sid) WHERE near IS NOT NULL) SELECT sid, CAST(round(MAX(score), 6) AS DOUBLE) AS score FROM u GROUP BY sid""")
def skeleton_passages(t: Tables):
    start = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sid"), F.round(F.col("o_totalprice") / 6e5, 4).alias("score"))
    related = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.lit(0.5).alias("sim"))
    return K.skeleton(start, related, X.sentences(t))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {_MEMBERS}, x AS (SELECT DISTINCT community, sid, doc_id, idx FROM member JOIN mention ON mention.eid = member.node JOIN sent USING (sid) WHERE community < 5), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY community ORDER BY doc_id, idx, sid) AS rank FROM x) SELECT community, sid, rank FROM r WHERE rank <= 5""")
def community_sentences(t: Tables):
    wanted = t.nation.where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("community"))
    return K.community_sentences(_members(t), wanted, X.mentions(t), X.sentences(t))


@query(f"WITH {SENTENCES}, {MENTIONS} SELECT sid, eid FROM sent JOIN mention USING (sid) JOIN orders ON o_orderkey = sid WHERE regexp_matches(o_orderpriority, '^[12]-')")
def signature_entities(t: Tables):
    """Sentences that fit a pattern, and the entities that they mention."""
    signed = t.orders.where(F.col("o_orderpriority").rlike("^[12]-")).select(F.col("o_orderkey").alias("sid"))
    return X.sentences(t).select("sid").join(signed, "sid", "left_semi").join(X.mentions(t), "sid")


@query(f"WITH {SENTENCES}, {_HITS} SELECT sid, doc_id, section_id, hit.score AS ppr FROM hit JOIN sent USING (sid)")
def sentences_by_ids(t: Tables):
    return hits(t).withColumnRenamed("score", "ppr").join(X.sentences(t).select("sid", "doc_id", "section_id"), "sid")


@query(f"""WITH {SENTENCES}, {MENTIONS}, c AS (SELECT section_id, eid, COUNT(*) AS mentions FROM sent JOIN mention USING (sid) WHERE section_id % 5 = 2 GROUP BY section_id, eid), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY mentions DESC, eid) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""")
def section_entities(t: Tables):
    return K.section_entities(t.nation.where("n_nationkey % 5 = 2").select(F.col("n_nationkey").cast("long").alias("section_id")), X.mentions(t), X.sentences(t))


@query(f"WITH {SENTENCES}, {MENTIONS}, {_MEMBERS}, {_DOCS} SELECT DISTINCT community FROM member WHERE node IN (SELECT eid FROM docs JOIN supplier ON s_suppkey = doc_id WHERE s_nationkey = 3)")
def communities_of_folder(t: Tables):
    return K.communities_of_folder(_members(t), G.documents_of(X.mentions(t), X.sentences(t)), t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("doc_id")))


@query(f"""WITH {RELATIONS}, {BOTH}, {_SEED}, a AS (SELECT DISTINCT seed.eid, arc.dst AS node FROM seed JOIN arc ON arc.src = seed.eid WHERE arc.dst <> seed.eid), b AS (SELECT DISTINCT a.eid, arc.dst AS node FROM a JOIN arc ON arc.src = a.node WHERE arc.dst <> a.eid), u AS (SELECT eid, node, 1 AS depth FROM a UNION ALL SELECT eid, node, 2 FROM b WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.eid = b.eid AND x.node = b.node)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY depth, node) AS r FROM u) SELECT eid, node, depth FROM r WHERE r <= 30""")
def relation_map(t: Tables):
    """Each seed's neighbourhood, nearest first, at most 30 nodes."""
    r = X.relations(t)
    both = r.select("src", "dst").union(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = seeds(t).select("eid", F.col("eid").alias("node"))
    seen, layers = front, []
    for depth in (1, 2):
        front = front.join(both, front["node"] == both["src"]).select("eid", F.col("dst").alias("node")).distinct().join(seen, ["eid", "node"], "left_anti")
        layers.append(front.withColumn("depth", F.lit(depth)))
        seen = seen.unionAll(front)
    return top_per_group(layers[0].unionAll(layers[1]), ["eid"], [F.col("depth"), F.col("node")], 30).select("eid", "node", "depth")


@query(f"WITH {RELATIONS}, {_EDGE} SELECT src, description, dst FROM edge JOIN part ON p_partkey = src WHERE p_type = 'ECONOMY' AND description IS NOT NULL AND w >= 1")
def triplets(t: Tables):
    return edges(t).where("description is not null and w >= 1").join(entities(t).where("kind = 'ECONOMY'").select(F.col("eid").alias("src")), "src", "left_semi").select("src", "description", "dst")


_FOLDERS = "tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 9 THEN p_partkey // 10 END AS parent FROM part)"


@query(f"WITH RECURSIVE {_FOLDERS}, up AS (SELECT id, id AS at FROM tree UNION ALL SELECT up.id, tree.parent FROM up JOIN tree ON tree.id = up.at WHERE tree.parent IS NOT NULL) SELECT up.id, up.at AS root FROM up JOIN tree ON tree.id = up.at WHERE tree.parent IS NULL")
def folder_roots(t: Tables):
    return K.roots(t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 9, F.floor(F.col("p_partkey") / 10)).alias("parent")))


@query(f"""WITH {SENTENCES}, {MENTIONS}, {RELATIONS}, {BOTH}, {_MEMBERS}, r AS (SELECT community, node, COUNT(*) AS degree, ROW_NUMBER() OVER (PARTITION BY community ORDER BY COUNT(*) DESC, node) AS rank FROM member JOIN arc ON arc.src = member.node GROUP BY community, node) SELECT * FROM r WHERE rank <= 3""")
def community_hubs(t: Tables):
    r = X.relations(t)
    both = r.select("src", "dst").union(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    rows = _members(t).join(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node")
    return top_per_group(rows, ["community"], [F.desc("degree"), F.col("node")], 3).select("community", "node", "degree", "rank")


@query("SELECT regexp_extract(url, '://([^/]*)', 1) AS host, COUNT(*) AS pages, COUNT(DISTINCT url) AS urls, CAST(SUM(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def document_stats(t: Tables):
    return t.pages.groupBy(F.regexp_extract("url", "://([^/]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"), F.sum(F.length("html")).alias("chars"))


@query("SELECT DISTINCT url FROM pages")
def indexed_urls(t: Tables):
    return t.pages.select("url").distinct()


@query("SELECT user_id, COUNT(*) AS calls, ROUND(SUM(value), 4) AS total, ROUND(SUM(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 4) AS failed FROM events GROUP BY user_id")
def request_totals(t: Tables):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)), 4).alias("failed"))


@query(f"""WITH {SENTENCES}, r AS (SELECT sid, doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY CAST(section_id % 5 <> 0 AS INT), idx) AS rank FROM sent) SELECT sid, doc_id, rank FROM r WHERE rank <= 4""")
def summary_sections_first(t: Tables):
    return top_per_group(X.sentences(t), ["doc_id"], [F.col("section_id") % 5 != 0, F.col("idx")], 4).select("sid", "doc_id", "rank")


@query(f"""WITH {SENTENCES}, m AS (SELECT sid, doc_id, section_id, score, CAST(contains(lower(n_name), '1') AS INT) + CAST(contains(lower(n_name), '_2') AS INT) + CAST(contains(lower(r_name), 'a') AS INT) AS hits FROM sent JOIN nation ON n_nationkey = section_id JOIN region ON r_regionkey = n_regionkey), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY hits DESC, score DESC, sid) AS r FROM m WHERE hits >= 2),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY hits DESC, score DESC, sid) AS r2 FROM a WHERE r <= 3) SELECT sid, hits FROM b WHERE r2 <= 2 ORDER BY hits DESC, score DESC, sid LIMIT 30""")
def section_boost(t: Tables):
    path = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").cast("long").alias("section_id"), F.lower("n_name").alias("n"), F.lower("r_name").alias("r"))
    count = sum(((F.col(c).contains(w)).cast("int") for c, w in (("n", "1"), ("n", "_2"), ("r", "a"))), F.lit(0))
    rows = X.sentences(t).join(path, "section_id").withColumn("hits", count).where("hits >= 2")
    return two_caps(rows, [F.desc("hits"), F.desc("score"), F.col("sid")], [("section_id", 3), ("doc_id", 2)], 30).select("sid", "hits")


@query(f"""WITH {SENTENCES}, r AS (SELECT sid, section_id, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY sid) AS h, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY sid DESC) AS t FROM sent) SELECT sid, section_id FROM r WHERE h <= 3 OR t <= 2""")
def section_spread(t: Tables):
    return K.spread(X.sentences(t), "section_id", [F.col("sid")], [F.desc("sid")], 5).select("sid", "section_id")


@query("SELECT event_id FROM events WHERE contains(props, '7')")
def chunks_by_section_path(t: Tables):
    """Rows of which any part of a JSON path fits a keyword."""
    path = F.from_json(F.concat(F.lit('["root","'), F.get_json_object("props", "$.k"), F.lit('"]')), "array<string>")
    return t.events.where(F.exists(path, lambda x: x.rlike("7"))).select("event_id")


@query(f"""WITH {SENTENCES}, {MENTIONS}, {_SEED}, x AS (SELECT eid, sid, doc_id, section_id, score FROM mention JOIN sent USING (sid) WHERE eid IN (SELECT eid FROM seed)), e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY eid ORDER BY score DESC, sid) AS r FROM x), d AS (SELECT sid, MIN(doc_id) AS doc_id, MIN(section_id) AS section_id, MIN(score) AS score FROM e WHERE r <= 4 GROUP BY sid), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY score DESC, sid) AS r1 FROM d),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS r2 FROM a WHERE r1 <= 3) SELECT sid, doc_id, section_id FROM b WHERE r2 <= 2 ORDER BY score DESC, sid LIMIT 40""")
def evidence_chunks(t: Tables):
    """Sentences of evidence entities under four caps: an entity, a section, a document and in all."""
    own = K.chunks_of_mentions(seeds(t), X.mentions(t), X.sentences(t)).select("eid", "sid").join(X.sentences(t), "sid")
    per = top_per_group(own, ["eid"], [F.desc("score"), F.col("sid")], 4).select("sid", "doc_id", "section_id", "score").distinct()
    return two_caps(per, [F.desc("score"), F.col("sid")], [("section_id", 3), ("doc_id", 2)], 40).select("sid", "doc_id", "section_id")


_LEVELS = "lev AS (SELECT n_nationkey AS community, 0 AS level, n_regionkey AS parent, n_name AS title FROM nation UNION ALL SELECT 100 + r_regionkey, 1, NULL, r_name FROM region)"


def _levels(t: Tables):
    low = t.nation.select(F.col("n_nationkey").alias("community"), F.lit(0).alias("level"), (F.col("n_regionkey") + 100).alias("parent"), F.col("n_name").alias("title"))
    return low.unionAll(t.region.select((F.col("r_regionkey") + 100).alias("community"), F.lit(1), F.lit(None).cast("int"), F.col("r_name")))


@query(f"WITH {_LEVELS} SELECT level, COUNT(*) AS n FROM lev GROUP BY level")
def community_levels(t: Tables):
    return _levels(t).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS community, n_name AS title, COALESCE(COUNT(s_suppkey), 0) AS members, COALESCE(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def communities_at_level(t: Tables):
    m = t.supplier.groupBy(F.col("s_nationkey").alias("community")).agg(F.count(F.lit(1)).alias("members"), F.array_join(F.transform(F.sort_array(F.collect_set("s_suppkey")), lambda x: x.cast("string")), ",").alias("ids"))
    return _levels(t).where("level = 0").join(m, "community", "left").select("community", "title", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("ids", F.lit("")).alias("ids"))


@query("SELECT 100 + n_regionkey AS parent, n_nationkey AS community, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY b DESC NULLS LAST, n_nationkey) AS rank FROM nation LEFT JOIN (SELECT s_nationkey, round(AVG(s_acctbal), 4) AS b FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def child_communities(t: Tables):
    """Children of each community by rank; those without one stand last."""
    rank = t.supplier.groupBy(F.col("s_nationkey").alias("community")).agg(F.round(F.avg("s_acctbal"), 4).alias("b"))
    rows = _levels(t).where("level = 0").join(rank, "community", "left")
    return top_per_group(rows, ["parent"], [F.desc_nulls_last("b"), F.col("community")], 1 << 30).select("parent", "community", "rank")


@query("WITH h AS (SELECT doc_id, CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) AS hits FROM documents) SELECT doc_id, hits FROM h WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 50")
def keyword_hits(t: Tables):
    """Words of a question that are no stop words, by how many a text holds."""
    words = F.array_except(F.split(F.lower(F.lit("what Tion of the QUE")), " "), F.array(F.lit("what"), F.lit("of")))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower("text"), w)))
    return t.documents.select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(50)


@query("SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def documents_by_status(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT doc_id, idx, substr(text, idx * 40 + 1, 40) AS sentence FROM documents, (SELECT unnest(range(3)) AS idx)")
def sentences_from_spans(t: Tables):
    spans = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("idx")).select("doc_id", "idx", (F.col("idx") * 40).alias("offset"), F.lit(40).alias("length"))
    return K.cut_spans(t.documents, spans, 3)


@query(f"WITH {SENTENCES} SELECT doc_id, COUNT(*) AS n, string_agg(CAST(sid AS VARCHAR), ',' ORDER BY idx) AS items FROM sent GROUP BY doc_id")
def documents_with_sentences(t: Tables):
    return K.nested_documents(X.sentences(t), "sid").select("doc_id", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"WITH {MENTIONS} SELECT sid, round(COUNT(DISTINCT eid) / 60.0, 6) AS score FROM mention JOIN part ON p_partkey = eid WHERE regexp_matches(p_name, '^(red|small) ') GROUP BY sid ORDER BY score DESC, sid LIMIT 60")
def sentences_by_entity_pattern(t: Tables):
    return K.by_entity_pattern(entities(t), X.mentions(t), "^(red|small) ", 60)


@query(f"""WITH {SENTENCES}, {MENTIONS}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY eid) AS r FROM mention), e AS (SELECT sid, COUNT(*) AS n_entities, string_agg(CASE WHEN r <= 3 THEN CAST(eid AS VARCHAR) END, ',' ORDER BY eid) AS entities FROM r GROUP BY sid),
v AS (SELECT sid, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS keys FROM sent JOIN nation a ON a.n_nationkey = section_id JOIN supplier ON s_suppkey = doc_id JOIN nation b ON b.n_nationkey = s_nationkey WHERE contains(upper('x ' || b.n_name || ' y'), upper(substr(a.n_name, 1, 20))) GROUP BY sid)
SELECT sid, n_entities, entities, keys FROM sent LEFT JOIN e USING (sid) LEFT JOIN v USING (sid)""")
def structured_chunks(t: Tables):
    nation = t.nation.select(F.col("n_nationkey").cast("long").alias("section_id"), F.col("n_name").alias("heading"))
    values = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("x "), F.col("n_name"), F.lit(" y")).alias("title"), F.col("s_name").alias("key"))
    out = K.structured(X.sentences(t).join(nation, "section_id"), values, X.mentions(t))
    return out.select("sid", "n_entities", F.array_join(F.transform("entities", lambda x: x.cast("string")), ",").alias("entities"), F.array_join("keys", ",").alias("keys"))


@query("SELECT doc_id, lang AS locale, CAST(n_chars AS BIGINT) AS length FROM documents UNION ALL SELECT doc_id, 'en', 1 FROM documents WHERE doc_id % 2 = 0")
def language_spans(t: Tables):
    """Spans of languages from their JSON form."""
    js = F.concat(F.lit('[{"locale":"'), F.col("lang"), F.lit('","offset":0,"length":'), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, '},{"locale":"en","offset":0,"length":1}]').otherwise("}]"))
    return t.documents.select("doc_id", F.explode(F.from_json(js, "array<struct<locale:string,offset:bigint,length:bigint>>")).alias("s")).select("doc_id", "s.locale", "s.length")


@query(f"WITH {SENTENCES}, {_HITS} SELECT sid, hit.score, c_acctbal AS x0 FROM hit LEFT JOIN orders ON o_orderkey = sid LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def citation_boxes(t: Tables):
    """Citations keep their place; the box is null where none is known."""
    boxes = t.orders.join(t.customer.where("c_custkey % 2 = 0"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("sid"), F.col("c_acctbal").alias("x0"))
    return hits(t).join(boxes, "sid", "left")


@query("SELECT source, COUNT(*) AS files, CAST(SUM(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def stored_sizes(t: Tables):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT page_id, 'doc_' || substr(sha256(COALESCE(NULLIF(trim(url, ' '), ''), CAST(page_id AS VARCHAR))), 1, 12) AS doc_id, CASE WHEN page_id % 2 = 0 THEN 'untitled' ELSE 'Page ' || CAST(page_id AS VARCHAR) END AS title FROM pages")
def prepared_documents(t: Tables):
    """Stable ids and titles for pages as they come in."""
    from ..functions import text as T

    key = T.document_key(F.col("url"), F.col("page_id").cast("string"))
    title = F.when(F.col("page_id") % 2 == 0, " ").otherwise(F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    return t.pages.select("page_id", T.stable_id("doc_", key).alias("doc_id"), T.document_key(title, F.lit("untitled")).alias("title"))
