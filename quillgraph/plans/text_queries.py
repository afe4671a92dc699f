"""Scalar functions, segmentation, filters and extraction over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import credits as C
from ..functions import text as T
from ..operators import extract as E
from ..operators import noise as N
from ..operators import routing
from ..operators import segment as S
from ..sources import readers
from .registry import Tables, query

_SPLIT = r"""pieces AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents),
trimmed AS (SELECT doc_id, k, trim(regexp_replace(p, '\s+', ' ', 'g')) AS sentence FROM pieces),
clean AS (SELECT * FROM trimmed WHERE sentence <> '')"""
_NOISE = r"""(length(sentence) < 20 OR len(string_split(sentence, ' ')) < 2 OR (len(string_split(sentence, ' ')) <= 5 AND upper(sentence) = sentence AND length(regexp_replace(sentence, '[^A-Za-z]', '', 'g')) > 0) OR length(trim(regexp_replace(sentence, '[0-9.,:;!?#$%&*()|/\-]', '', 'g'))) < 8)"""
_SENTENCES = f"""{_SPLIT}, sents AS (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, sentence FROM clean WHERE NOT {_NOISE})"""


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_& ]', ' ', 'g'), ' +', ' ', 'g')) AS key, 'entity_' || substr(sha256('g1' || chr(10) || trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_& ]', ' ', 'g'), ' +', ' ', 'g'))), 1, 12) AS id, 'sec_' || substr(md5(CAST(p_size AS VARCHAR) || ':' || p_type), 1, 16) AS section FROM part")
def stable_ids(t: Tables):
    key = T.canonical_key(F.col("p_name"))
    return t.part.select("p_partkey", key.alias("key"), T.stable_id("entity_", F.lit("g1"), key).alias("id"), T.section_id(F.col("p_size").cast("string"), F.col("p_type")).alias("section"))


@query(r"""SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, GREATEST(1, CAST(floor(length(regexp_replace(text, '[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]', '', 'g')) * 1.5) AS BIGINT) + CAST(length(regexp_replace(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\s]', '', 'g')) // 4 AS BIGINT)) AS tokens_cjk FROM documents""")
def token_estimates(t: Tables):
    return t.documents.select("doc_id", T.tokens_by_length(F.col("text")).alias("tokens"), T.tokens_cjk(F.col("text")).alias("tokens_cjk"))


@query(r"""SELECT doc_id, n_letters, n_foreign, n_letters > 0 AND n_foreign > 0.2 * n_letters AS foreign_script FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{L}]|[A-Za-z]', '', 'g')) AS n_foreign FROM documents) x""")
def non_latin(t: Tables):
    letters, foreign = F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.length(F.regexp_replace("text", r"[^\p{L}]|[A-Za-z]", ""))
    return t.documents.select("doc_id", letters.cast("long").alias("n_letters"), foreign.cast("long").alias("n_foreign"), (T.non_latin_share(F.col("text")) > 0.2).alias("foreign_script"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS found FROM orders")
def document_dates(t: Tables):
    """Dates are written in one of five formats, by order, and found again."""
    d = F.to_date("o_orderdate")
    forms = ["M/d/yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "d. MMMM yyyy", "d.M.yyyy"]
    text = F.element_at(F.array(*[F.concat(F.lit("Made on "), F.date_format(d, f), F.lit(" between 99/99/9999 and 1.1.1700.")) for f in forms]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", T.document_date(text).alias("found"))


@query(r"SELECT item_id, trim(regexp_replace(text || ' [1] and [12a]', '\s*\[[0-9]+[a-z]\]', '', 'g')) AS plain, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS terms FROM benchmark")
def marker_stripping(t: Tables):
    return t.benchmark.select("item_id", T.strip_markers(F.concat("text", F.lit(" [1] and [12a]"))).alias("plain"), T.fulltext_terms(F.col("text")).alias("terms"))


@query("SELECT n_nationkey, r_name || ' > ' || n_name AS path, n_name AS leaf, r_name AS first_prefix, contains(lower(n_name), 'scope') AS summary FROM nation JOIN region ON r_regionkey = n_regionkey")
def section_paths(t: Tables):
    path = F.concat_ws(" > ", "r_name", "n_name")
    return t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", path.alias("path"), T.leaf_title(path).alias("leaf"), F.element_at(T.path_prefixes(path), 1).alias("first_prefix"), T.is_summary_title(F.col("n_name")).alias("summary"))


@query("""WITH p AS (SELECT DISTINCT c_nationkey % 7 AS doc_id, r_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, r_name AS path, r_name AS title, 1 AS depth, CAST(NULL AS VARCHAR) AS parent FROM p UNION ALL SELECT CAST(doc_id AS BIGINT), r_name || ' > ' || n_name, n_name, 2, r_name FROM p)
SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, COALESCE(parent, '') ORDER BY path) AS ordinal FROM s""")
def section_tree(t: Tables):
    n = t.customer.select("c_nationkey").distinct().join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    return S.section_tree(n.select((F.col("c_nationkey") % 7).cast("long").alias("doc_id"), F.concat_ws(" > ", "r_name", "n_name").alias("path")))


@query(f"WITH {_SENTENCES} SELECT doc_id, idx, sentence FROM sents")
def split_sentences(t: Tables):
    return S.sentences(t.documents)


@query(f"""WITH {_SENTENCES}, k AS (SELECT lower(trim(sentence)) AS key, doc_id, idx, ROW_NUMBER() OVER (PARTITION BY lower(trim(sentence)) ORDER BY doc_id, idx) AS r, COUNT(*) OVER (PARTITION BY lower(trim(sentence))) AS copies FROM sents)
SELECT doc_id, idx, key, copies FROM k WHERE r = 1""")
def sentence_dedup(t: Tables):
    return S.first_occurrences(S.sentences(t.documents))


@query(rf"""WITH {_SPLIT} SELECT CASE WHEN length(sentence) < 15 THEN 'noise' WHEN length(sentence) < 40 AND sentence LIKE '%:' THEN 'noise' WHEN length(regexp_replace(sentence, '[^0-9]', '', 'g')) * 2 > length(sentence) THEN 'noise' WHEN regexp_matches(sentence, '^[A-Za-z ]{{1,30}}: \S') THEN 'metadata' ELSE 'content' END AS kind, COUNT(*) AS n FROM clean GROUP BY 1""")
def sentence_classes(t: Tables):
    return S.sentences(t.documents, drop_noise=False).groupBy(S.classify(F.col("sentence")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT conv_id * 1000 + turn AS src, LEAD(conv_id * 1000 + turn) OVER w AS dst, role, LEAD(role) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT src, dst, 'NEXT' AS kind FROM s WHERE dst IS NOT NULL UNION ALL SELECT src, dst, 'NEXT_IN_SECTION' FROM s WHERE dst IS NOT NULL AND role = r2 AND role <> ''""")
def next_edges(t: Tables):
    return S.next_edges(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sid"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "role"), "role")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0), c AS (SELECT doc_id, w, unnest(generate_series(0, GREATEST(CAST(ceil((n - 64) / 448.0) AS BIGINT) - 1, 0))) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, len(list_slice(w, i * 448 + 1, i * 448 + 512)) AS n_words, array_to_string(list_slice(w, i * 448 + 1, i * 448 + 512), ' ') AS chunk FROM c""")
def fixed_chunks(t: Tables):
    return S.windows(t.documents)


@query(f"""WITH {_SENTENCES}, s AS (SELECT doc_id, idx, ROUND(LEAST(1.0, length(sentence) / 100.0) / (idx + 1), 6) AS score FROM sents), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM s)
SELECT doc_id, idx, rank, score FROM r WHERE rank <= 3""")
def extractive_summary(t: Tables):
    return S.lead_sentences(S.sentences(t.documents))


@query(f"""WITH {_SENTENCES} SELECT doc_id, idx, substr(concat_ws(' ', LAG(sentence) OVER w, sentence, LEAD(sentence) OVER w), 1, 500) AS context FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def sentence_context(t: Tables):
    return S.in_context(S.sentences(t.documents))


@query(r"""WITH RECURSIVE m AS (SELECT conv_id AS doc_id, turn AS idx, COALESCE(text, '') AS text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT *, rtrim(text, E' \t\r\n') LIKE '%:' OR (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 3 AND NOT contains(text, '.')) AS stub FROM m),
g AS (SELECT doc_id, idx, k, text, stub AS held FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.idx, s.k, s.text, s.stub AND NOT g.held FROM g JOIN s ON s.doc_id = g.doc_id AND s.k = g.k + 1),
n AS (SELECT *, LEAD(text) OVER w AS nxt, COALESCE(LAG(held) OVER w, false) AS taken FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, idx, CASE WHEN held AND nxt IS NOT NULL THEN trim(text || ' ' || nxt, E' \t\r\n') ELSE text END AS text FROM n WHERE NOT taken""")
def joined_stubs(t: Tables):
    return S.join_stubs(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text"))


@query("""WITH RECURSIVE m AS (SELECT conv_id AS doc_id, turn AS idx, length(text) // 4 AS w, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), g AS (
  SELECT doc_id, idx, k, w AS used, 0 AS bin FROM m WHERE k = 1
  UNION ALL SELECT m.doc_id, m.idx, m.k, CASE WHEN used + w <= 200 THEN used + w ELSE w END, bin + CASE WHEN used + w <= 200 THEN 0 ELSE 1 END FROM g JOIN m ON m.doc_id = g.doc_id AND m.k = g.k + 1)
SELECT doc_id, idx, bin FROM g""")
def next_fit_bins(t: Tables):
    return S.next_fit(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), T.tokens_by_length(F.col("text")).alias("tokens")), 200)


_PENALTY = r"""CAST(ROUND(CASE WHEN len(l) = 0 THEN 0.10 WHEN len(list_filter(l, lambda x: regexp_matches(x, '^(?:[A-Za-z0-9 ''/()-]+:\s*(?:[_.-]{2,}|\[?\s*\]?)|[_.=-]{4,})$'))) * 2 >= len(l) THEN 0.05 ELSE 1.0 END
 * CASE WHEN length(regexp_replace(text, '[\s_.=:|/\[\]()#*>`-]+', '', 'g')) < 20 THEN 0.10 ELSE 1.0 END
 * CASE WHEN length(text) // 4 + 1 < 50 AND NOT regexp_matches(text, '[A-Za-z][A-Za-z0-9 /()''-]+:\s*[A-Za-z0-9]') THEN 0.20 ELSE 1.0 END, 6) AS DOUBLE) AS penalty"""
_LINES = r"""x AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM (SELECT doc_id, COALESCE(text, '') AS text FROM documents) d)"""


@query(f"WITH {_LINES} SELECT doc_id, {_PENALTY} FROM x")
def noise_penalties(t: Tables):
    return t.documents.select("doc_id", N.noise_penalty(F.col("text")).alias("penalty"))


@query(rf"""WITH {_SPLIT} SELECT doc_id, COUNT(*) AS kept FROM clean WHERE NOT (len(regexp_extract_all(sentence, '<[^>]+>')) >= 2 OR length(sentence) < 25 OR regexp_matches(sentence, '(?i)^\s*(signature|signed by|print name|date)\s*[:_]') OR (length(sentence) < 60 AND sentence LIKE '%:') OR (length(sentence) < 50 AND NOT regexp_matches(sentence, '[.?!]'))) GROUP BY doc_id""")
def denoised_sentences(t: Tables):
    return S.sentences(t.documents, drop_noise=False).where(N.denoised(F.col("sentence"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT doc_id, ROUND(CASE WHEN contains(text, '$') THEN 5 WHEN contains(lower(text), 'amount') THEN 4 WHEN contains(lower(text), 'invoice') THEN 3 WHEN contains(lower(text), 'cost') THEN 2 WHEN contains(lower(text), 'price') THEN 1 ELSE 0 END / 5.0, 6) AS score FROM documents""")
def numeric_relevance(t: Tables):
    return t.documents.select("doc_id", N.numeric_relevance(F.col("text")).alias("score"))



_F = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, unnest(regexp_extract_all(text, '{v}')) AS value FROM documents" for k, v in E.FIELDS.items())


@query(f"SELECT doc_id, field, value, COUNT(*) AS n FROM ({_F}) x GROUP BY doc_id, field, value")
def regex_fields(t: Tables):
    return E.fields(t.documents)


@query(f"WITH f AS (SELECT DISTINCT doc_id, field, value FROM ({_F}) x), o AS (SELECT field, value, MIN(doc_id) AS doc_id FROM f GROUP BY field, value HAVING COUNT(*) = 1) SELECT doc_id, field, COUNT(*) AS only_here FROM o GROUP BY doc_id, field")
def field_comparison(t: Tables):
    return E.exclusive_values(E.fields(t.documents))


@query("""WITH w AS (SELECT a.item_id AS id, a.text AS expected, b.text AS actual, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(a.text), '[^a-z0-9$% ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda x: x <> '')) AS e, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(b.text), '[^a-z0-9$% ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda x: x <> '')) AS p FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
h AS (SELECT *, len(list_intersect(e, p)) AS hit FROM w), r AS (SELECT *, CASE WHEN len(p) > 0 THEN CAST(hit AS DOUBLE) / len(p) ELSE 0.0 END AS pr, CASE WHEN len(e) > 0 THEN CAST(hit AS DOUBLE) / len(e) ELSE 0.0 END AS re FROM h)
SELECT id, ROUND(pr, 6) AS "precision", ROUND(re, 6) AS recall, ROUND(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1, contains(lower(actual), lower(expected)) AS contained FROM r""")
def accuracy_metrics(t: Tables):
    b = t.benchmark.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("actual"))
    return E.accuracy(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("expected")).join(b, "id"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_matches(lower(regexp_extract(url, '^https?://(?:[^/@?#]*@)?([^/?#]*)', 1)), '^(localhost|127\\..*|10\\..*|192\\.168\\..*)$') = false AND regexp_extract(url, '^https?://(?:[^/@?#]*@)?([^/?#]*)', 1) <> '' AS safe FROM pages""")
def html_titles(t: Tables):
    return readers.html_pages(t.pages).select("page_id", "title", readers.safe_url(F.col("url")).alias("safe"))


@query("SELECT event_id, 0 AS page, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_properties(t: Tables):
    return readers.json_pages(t.events.select("event_id", "props"), "props").select("event_id", "page", F.get_json_object("content", "$.k").cast("long").alias("k"))


_ROUTE = "CASE WHEN " + " OR ".join(f"contains(q, '{w}')" for w in routing.MULTI_HOP) + " THEN 'multi_hop' WHEN " + " OR ".join(f"contains(q, '{w}')" for w in routing.THEMATIC) + " THEN 'thematic' ELSE 'local' END"
_QUESTIONS = ["how does '||x||' work", "compare '||x||' with it", "summarize '||x||'", "latest document of '||x||'", "what is '||x||'"]


@query("SELECT conv_id, turn, route, order_by FROM (SELECT conv_id, turn, " + _ROUTE + " AS route, CASE WHEN contains(q, 'document') AND contains(q, 'latest') THEN 'desc' END AS order_by FROM (SELECT conv_id, turn, lower(CASE turn % 5 " + " ".join(f"WHEN {i} THEN '" + q.replace("'||x||'", "' || role || '") + "'" for i, q in enumerate(_QUESTIONS)) + " END) AS q FROM conversations) y) z")
def question_routes(t: Tables):
    q = F.element_at(F.array(*[F.concat(*[F.lit(p) if i % 2 == 0 else F.col("role") for i, p in enumerate(x.replace("'||x||'", "\1x\1").split("\1"))]) for x in _QUESTIONS]), (F.col("turn") % 5 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", routing.route(q).alias("route"), routing.date_order(q).alias("order_by"))


@query("SELECT event_id, GREATEST(1, CAST(ceil(ROUND((value * 100 * 0.15 / 1e6 + value * 10 * 0.6 / 1e6) / 0.001, 6)) AS BIGINT)) AS llm, GREATEST(1, CAST(ceil(ROUND(value * 1000 * 0.12 / 1e6 / 0.001, 6)) AS BIGINT)) AS embedding FROM events")
def call_credits(t: Tables):
    return t.events.select("event_id", C.llm_credits(F.lit("small"), F.col("value") * 100, F.col("value") * 10).alias("llm"), C.embedding_credits(F.col("value") * 1000).alias("embedding"))
