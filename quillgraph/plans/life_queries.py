"""Entity resolution, lifecycle, garbage collection and metering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import credits as C
from ..operators import lifecycle as L
from ..operators import metering as M
from ..operators import resolve as RS
from . import fixture as X
from .fixture import MENTIONS, RELATIONS, SENTENCES
from .registry import Tables, query

_GONE = "gone AS (SELECT CAST(doc_id AS BIGINT) AS doc_id FROM labels WHERE quality = 0)"
_STATE = f"{_GONE}, state AS (SELECT sid, doc_id, doc_id IN (SELECT doc_id FROM gone) AS deprecated FROM sent)"


def _gone(t: Tables):
    return t.labels.where("quality = 0").select("doc_id")


@query(f"WITH {SENTENCES}, {_STATE} SELECT sid, doc_id, deprecated, CASE WHEN deprecated THEN 'parent_deprecated' END AS reason FROM state")
def deprecate_documents(t: Tables):
    return L.deprecate(X.sentences(t), _gone(t))


@query(f"WITH {SENTENCES}, {_STATE} SELECT sid, doc_id, deprecated AND doc_id % 2 = 1 AS deprecated, CASE WHEN deprecated AND doc_id % 2 = 1 THEN 'parent_deprecated' END AS reason FROM state")
def restore_documents(t: Tables):
    return L.restore(L.deprecate(X.sentences(t), _gone(t)), _gone(t).where("doc_id % 2 = 0"))


@query(f"WITH {SENTENCES}, {MENTIONS}, gone AS (SELECT DISTINCT doc_id FROM sent WHERE doc_id % 3 <> 0), alive AS (SELECT DISTINCT eid FROM mention JOIN sent USING (sid) WHERE doc_id NOT IN (SELECT doc_id FROM gone)) SELECT DISTINCT eid FROM mention WHERE eid NOT IN (SELECT eid FROM alive)")
def orphan_entities(t: Tables):
    s = X.sentences(t)
    return L.orphans(X.mentions(t), L.deprecate(s, s.where("doc_id % 3 <> 0").select("doc_id")))


@query(f"""WITH {SENTENCES}, {MENTIONS}, p AS (SELECT eid, doc_id, COUNT(*) AS m FROM mention JOIN sent USING (sid) GROUP BY eid, doc_id), o AS (SELECT doc_id, COUNT(*) AS orphans FROM (SELECT eid, MIN(doc_id) AS doc_id FROM p GROUP BY eid HAVING COUNT(*) = 1) x GROUP BY doc_id)
SELECT s.doc_id, COUNT(*) AS sentences, COALESCE(MAX(q.m), 0) AS mentions, COALESCE(MAX(o.orphans), 0) AS orphans FROM sent s LEFT JOIN (SELECT doc_id, CAST(SUM(m) AS BIGINT) AS m FROM p GROUP BY doc_id) q ON q.doc_id = s.doc_id LEFT JOIN o ON o.doc_id = s.doc_id GROUP BY s.doc_id""")
def deletion_impact(t: Tables):
    s = X.sentences(t)
    return L.impact(X.mentions(t), s, s.select("doc_id"))


@query(f"WITH {SENTENCES}, {_STATE}, e AS (SELECT sid AS src, LEAD(sid) OVER (PARTITION BY section_id ORDER BY sid) AS dst FROM sent), d AS (SELECT sid FROM state WHERE deprecated) SELECT src, dst FROM e WHERE dst IS NOT NULL AND (src IN (SELECT sid FROM d) OR dst IN (SELECT sid FROM d))")
def stale_edges(t: Tables):
    from pyspark.sql import Window

    s = X.sentences(t)
    edges = s.select(F.col("sid").alias("src"), F.lead("sid").over(Window.partitionBy("section_id").orderBy("sid")).alias("dst")).where("dst is not null")
    return L.stale_edges(edges, L.deprecate(s, _gone(t)))


@query("SELECT 'documents' AS label, COUNT(*) FILTER (WHERE NULLIF(CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END, '') IS NULL) AS missing FROM documents UNION ALL SELECT 'conversations', COUNT(*) FILTER (WHERE NULLIF(role, '') IS NULL) FROM conversations")
def group_isolation(t: Tables):
    d = t.documents.select(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("group_id"))
    return L.isolation({"documents": d, "conversations": t.conversations.select(F.col("role").alias("group_id"))})


@query(f"""WITH {SENTENCES}, {MENTIONS}, {_STATE}, s AS (SELECT sent.*, deprecated FROM sent JOIN state USING (sid)),
d AS (SELECT section_id, COUNT(*) AS documents, COUNT(*) FILTER (WHERE gone) AS deprecated FROM (SELECT section_id, doc_id, bool_and(deprecated) AS gone FROM s GROUP BY 1, 2) x GROUP BY 1),
e AS (SELECT section_id, COUNT(*) AS entities, COUNT(*) FILTER (WHERE gone) AS orphans FROM (SELECT section_id, eid, bool_and(deprecated) AS gone FROM s JOIN mention USING (sid) GROUP BY 1, 2) x GROUP BY 1),
n AS (SELECT section_id, deprecated, LEAD(sid) OVER w AS dst, LEAD(deprecated) OVER w AS other FROM s WINDOW w AS (PARTITION BY section_id ORDER BY sid)),
st AS (SELECT section_id, COUNT(*) FILTER (WHERE dst IS NOT NULL AND (deprecated OR other)) AS stale FROM n GROUP BY 1),
late AS (SELECT c_nationkey AS section_id, COALESCE(MAX(o_orderdate) > MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END), true) AS is_stale FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
v AS (SELECT (SELECT COUNT(*) FROM documents WHERE COALESCE(lang, '') = '') + (SELECT COUNT(*) FROM conversations WHERE COALESCE(role, '') = '') AS missing)
SELECT d.section_id AS group_id, documents, d.deprecated, COALESCE(entities, 0) AS entities, COALESCE(orphans, 0) AS orphans, stale, is_stale, missing,
GREATEST(ROUND(100.0::DOUBLE - LEAST(20.0, CASE WHEN entities > 0 THEN 100.0 * (orphans / entities::DOUBLE) ELSE 0.0 END) - LEAST(15.0, stale / 10.0::DOUBLE) - CASE WHEN is_stale THEN 10.0 ELSE 0.0 END - LEAST(30.0, 5.0 * missing) - LEAST(10.0, 20.0 * GREATEST(d.deprecated / documents::DOUBLE - 0.5, 0.0)), 1), 0.0) AS score
FROM d LEFT JOIN e USING (section_id) JOIN st USING (section_id) JOIN late USING (section_id), v""")
def health_scores(t: Tables):
    """Health of every nation's part of the graph; an order that is finished has been computed."""
    from pyspark.sql import Window

    s = X.sentences(t)
    s = s.join(L.deprecate(s, _gone(t)).select("sid", "deprecated"), "sid").select("sid", "doc_id", F.col("section_id").alias("group_id"), "deprecated")
    edges = s.select(F.col("sid").alias("src"), F.lead("sid").over(Window.partitionBy("group_id").orderBy("sid")).alias("dst")).where("dst is not null")
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("group_id"))
    computed = orders.agg(F.max("o_orderdate").alias("last_change"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_computed"))
    missing = L.isolation({"documents": t.documents.select(F.col("lang").alias("group_id")), "conversations": t.conversations.select(F.col("role").alias("group_id"))})
    return L.health(s, X.mentions(t), edges, computed, missing).select("group_id", "documents", "deprecated", "entities", "orphans", "stale", "is_stale", "missing", "score")


@query(f"""WITH {RELATIONS}, e AS (SELECT src % 100 AS src, dst % 100 AS dst, 'part ' || CAST(dst AS VARCHAR) AS description, src * 100000 + dst AS seq FROM rel), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY seq) AS k, COUNT(*) OVER (PARTITION BY src, dst) AS cooccurrence FROM e)
SELECT src, dst, description, cooccurrence, CAST(cooccurrence AS DOUBLE) AS weight FROM r WHERE k = 1""")
def upsert_relations(t: Tables):
    e = X.relations(t).select((F.col("src") % 100).alias("src"), (F.col("dst") % 100).alias("dst"), F.concat(F.lit("part "), F.col("dst").cast("string")).alias("description"), (F.col("src") * 100000 + F.col("dst")).alias("seq"))
    return RS.upsert_edges(e)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '-new' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def upsert_documents(t: Tables):
    now = t.documents.select("doc_id", "lang", F.lit(1).alias("version"))
    new = t.documents.where("doc_id % 3 = 0").select("doc_id", F.concat("lang", F.lit("-new")).alias("lang"), F.lit(2).alias("version"))
    return RS.upsert(now, new, ["doc_id"], "version")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT upper(substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) FROM part WHERE split_part(p_name, ' ', 2) <> '' AND split_part(p_name, ' ', 3) = '') SELECT COUNT(*) AS names FROM n""")
def entity_names(t: Tables):
    """Distinct names and two-letter acronyms, the input of `entity_resolution`."""
    return _names(t).agg(F.count(F.lit(1)).alias("names"))


def _names(t: Tables):
    two = F.split("p_name", " ")
    acronyms = t.part.where(F.size(two) == 2).select(F.upper(F.concat(F.substring(two[0], 1, 1), F.substring(two[1], 1, 1))).alias("name"))
    return t.part.select(F.col("p_name").alias("name")).unionAll(acronyms).distinct()


@query()
def entity_resolution(t: Tables):
    return RS.merge_map(_names(t))


@query("""WITH b AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m') AS m FROM events) SELECT user_id, 'day' AS period, d AS bucket, COUNT(*) AS n FROM b GROUP BY user_id, d UNION ALL SELECT user_id, 'month', m, COUNT(*) FROM b GROUP BY user_id, m""")
def usage_counters(t: Tables):
    return M.calendar_counters(t.events)


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS bucket, COUNT(*) AS used, COUNT(*) <= 3 AS allowed, GREATEST(3 - COUNT(*), 0) AS remaining FROM events GROUP BY user_id, 2")
def daily_quota(t: Tables):
    return M.quota(t.events, 3)


@query("SELECT event_id, COUNT(*) OVER w AS recent, COUNT(*) OVER w > 2 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)")
def sliding_rate_limit(t: Tables):
    return M.sliding_count(t.events, 3600, 2)


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, CAST(SUM(GREATEST(1, CAST(ceil(ROUND(value * 1000 * 0.12 / 1e6 / 0.001, 6)) AS BIGINT))) AS BIGINT) AS credits FROM events GROUP BY user_id, 2")
def monthly_credits(t: Tables):
    return M.credits_by_month(t.events, C.embedding_credits(F.col("value") * 1000))


@query("SELECT user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MAX(ts) AS last FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 50")
def user_activity(t: Tables):
    return M.user_activity(t.events, 50)


@query("SELECT date_trunc('hour', ts) AS bucket, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def hour_buckets(t: Tables):
    return M.hour_buckets(t.events)


@query("WITH l AS (SELECT MAX(CAST(ts AS DATE)) AS day FROM events) SELECT COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT event_type) AS types, COUNT(*) FILTER (WHERE CAST(ts AS DATE) = day) AS last_day, COUNT(*) FILTER (WHERE date_trunc('month', ts) = date_trunc('month', day)) AS last_month FROM events, l")
def system_metrics(t: Tables):
    return M.system_metrics(t.events)


@query("""WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase')), n AS (SELECT event_id, user_id, event_type, ts, LEAD(event_type) OVER w AS nx, LEAD(ts) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id FROM n WHERE event_type = 'click' AND (nxt IS NULL OR nx <> 'purchase' OR CAST(floor(epoch(nxt)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) > 7200)""")
def stale_jobs(t: Tables):
    return M.stale_jobs(t.events, "click", "purchase", 7200)
