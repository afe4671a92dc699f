"""Cutting, joining and batching of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages as P
from . import fixture as X
from .fixture import SENTENCES
from .layout_queries import _PARA, paras
from .registry import Tables, query


@query(r"""SELECT item_id, text || CASE WHEN regexp_matches(text, '[.!?:]$') THEN ' ' ELSE '. ' END || 'item one' AS plain FROM (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS text FROM benchmark)""")
def plain_texts(t: Tables):
    marked = F.concat(F.lit("<!-- x\n y -->\n# Heading\n"), F.col("text"), F.lit("\n\n| a | b |\n<table><tr>1</tr></table>\n\n- item one\n<figure>z</figure>\nSigned by\nA. B.\nDate"))
    return t.benchmark.select("item_id", P.plain_text(marked).alias("plain"))


_LINES = "lines AS (SELECT p_size AS doc_id, ROW_NUMBER() OVER (PARTITION BY p_size ORDER BY p_partkey) AS idx, CASE WHEN p_partkey % 5 = 0 THEN 'A plain line of text.' ELSE p_name || ': ' || p_brand END AS text FROM part)"


def _lines(t: Tables):
    from pyspark.sql import Window

    text = F.when(F.col("p_partkey") % 5 == 0, "A plain line of text.").otherwise(F.concat("p_name", F.lit(": "), "p_brand"))
    return t.part.select(F.col("p_size").alias("doc_id"), F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("idx"), text.alias("text"))


@query(f"""WITH RECURSIVE {_LINES}, m AS (SELECT *, contains(text, ':') AS pair, len(string_split(text, ' ')) AS w FROM lines), g AS (
  SELECT doc_id, idx, pair, w AS used, 0 AS piece, text FROM m WHERE idx = 1
  UNION ALL SELECT m.doc_id, m.idx, m.pair, CASE WHEN m.pair AND g.pair AND used + w <= 8 THEN used + w ELSE w END, piece + CASE WHEN m.pair AND g.pair AND used + w <= 8 THEN 0 ELSE 1 END, m.text FROM g JOIN m ON m.doc_id = g.doc_id AND m.idx = g.idx + 1)
SELECT doc_id, MIN(idx) AS idx, COUNT(*) AS n, string_agg(text, ' | ' ORDER BY idx) AS text FROM g GROUP BY doc_id, piece""")
def joined_pairs(t: Tables):
    return P.joined_pairs(_lines(t), most=8)


@query("SELECT item_id, item_id % 2 = 0 AS same FROM benchmark")
def boundary_reviews(t: Tables):
    whole = F.array(F.col("text"))
    moved = F.when(F.col("item_id") % 2 == 0, F.array(F.substr("text", F.lit(1), F.lit(7)), F.substr("text", F.lit(8)))).otherwise(F.array(F.col("text"), F.lit("x")))
    return t.benchmark.select("item_id", P.same_text(whole, moved).alias("same"))


@query(r"""WITH RECURSIVE p AS (SELECT conv_id AS doc_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k, trim(regexp_replace(text, '\n\n+', chr(10), 'g'), E' \t\r\n\v\f') AS p FROM conversations WHERE trim(text, E' \t\r\n\v\f') <> ''),
w AS (SELECT *, len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) AS n FROM p), g AS (
  SELECT doc_id, k, 0 AS piece, n AS used, p AS text FROM w WHERE k = 1
  UNION ALL SELECT w.doc_id, w.k, CASE WHEN used + n <= 100 THEN piece ELSE piece + 1 END, CASE WHEN used + n <= 100 THEN used + n WHEN used > 10 THEN n + 10 ELSE n END,
    CASE WHEN used + n <= 100 THEN text || chr(10) || chr(10) || p WHEN used > 10 THEN array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[-10:], ' ') || chr(10) || chr(10) || p ELSE p END
  FROM g JOIN w ON w.doc_id = g.doc_id AND w.k = g.k + 1)
SELECT doc_id, piece, arg_max(text, k) AS text FROM g GROUP BY doc_id, piece""")
def large_sections_split(t: Tables):
    turns = t.conversations.where(F.trim("text") != "").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", F.regexp_replace("text", r"\n\n+", "\n").alias("text"))))["text"], "\n\n").alias("text"))
    return P.split_large(turns, 100, 10)


@query("SELECT doc_id, piece, substr(text, piece * 500 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS INT))) AS piece FROM documents WHERE length(text) > 0)")
def fixed_slices(t: Tables):
    return P.slices(t.documents, 500)


@query(r"""WITH RECURSIVE h AS (SELECT conv_id * 100 + turn AS doc_id, '' AS path, text FROM conversations UNION ALL SELECT doc_id, path || s, CASE s WHEN '0' THEN trim(substr(text, 1, cut), ' ') ELSE trim(substr(text, cut + 1), ' ') END FROM (SELECT *, m + CASE WHEN strpos(substr(text, m), ' ') > 0 THEN strpos(substr(text, m), ' ') - 1 ELSE 0 END AS cut FROM (SELECT *, CAST(ceil(length(text) / 2.0) AS INT) AS m FROM h WHERE length(text) // 4 + 1 > 30) x) y, (VALUES ('0'), ('1')) v(s))
SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS piece, text FROM h WHERE length(text) // 4 + 1 <= 30""")
def halved_pages(t: Tables):
    return P.halves(t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text"), 30)


@query("""WITH RECURSIVE m AS (SELECT conv_id AS doc_id, turn AS page, length(text) AS w, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), g AS (
  SELECT doc_id, page, k, w, w AS used, 0 AS piece FROM m WHERE k = 1
  UNION ALL SELECT m.doc_id, m.page, m.k, m.w, CASE WHEN used + m.w <= 900 THEN used + m.w ELSE m.w END, piece + CASE WHEN used + m.w <= 900 THEN 0 ELSE 1 END FROM g JOIN m ON m.doc_id = g.doc_id AND m.k = g.k + 1)
SELECT doc_id, piece, MIN(page) AS first_page, MAX(page) AS last_page, CAST(SUM(w) AS BIGINT) AS n_tokens FROM g GROUP BY doc_id, piece""")
def filled_pages(t: Tables):
    return P.filled_pages(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.length("text").alias("tokens")), 900)


@query(r"""WITH n AS (SELECT conv_id AS doc_id, turn AS idx, text, LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), h AS (SELECT *, regexp_extract(substr(nxt, 1, CAST(floor(length(nxt) * 0.1) AS INT)), '^(.*)\s', 1) AS head FROM n) SELECT doc_id, idx, CASE WHEN head <> '' THEN text || ' ' || head ELSE text END AS text FROM h""")
def chunks_with_overlap(t: Tables):
    return P.with_overlap(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text"))


@query("""WITH RECURSIVE m AS (SELECT doc_id, source, n_chars AS w, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), g AS (
  SELECT doc_id, source, k, w AS used, 1 AS n, 0 AS batch FROM m WHERE k = 1
  UNION ALL SELECT m.doc_id, m.source, m.k, CASE WHEN used + w >= 5000 OR n = 4 THEN w ELSE used + w END, CASE WHEN used + w >= 5000 OR n = 4 THEN 1 ELSE n + 1 END, batch + CASE WHEN used + w >= 5000 OR n = 4 THEN 1 ELSE 0 END FROM g JOIN m ON m.source = g.source AND m.k = g.k + 1)
SELECT doc_id, source, batch FROM g""")
def token_batches(t: Tables):
    return P.batches(t.documents.select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 5000, 4).select("doc_id", "source", "batch")


@query(f"""WITH {SENTENCES}, n AS (SELECT *, COALESCE(CAST(section_id <> LAG(section_id) OVER (PARTITION BY doc_id ORDER BY idx) AS INT), 1) AS new FROM sent), r AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT sid, doc_id, run, (ROW_NUMBER() OVER (PARTITION BY doc_id, run ORDER BY idx) - 1) // 2 AS batch FROM r""")
def section_batches(t: Tables):
    return P.section_batches(X.sentences(t), 2)


@query("SELECT conv_id AS doc_id, turn AS sid, turn AS box_id FROM conversations QUALIFY COUNT(*) OVER (PARTITION BY conv_id, lower(text)) = 1 AND length(text) >= 80 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 8 AND COUNT(*) OVER (PARTITION BY conv_id, lower(substr(text, 1, 40))) = 1")
def sentence_boxes_by_text(t: Tables):
    """Every turn is found again by its first half, where its conversation has no other turn that begins like it."""
    from pyspark.sql import Window

    turns = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sid"), "text")
    one = lambda c: F.count(F.lit(1)).over(Window.partitionBy("doc_id", c))
    clear = turns.withColumns({"a": one(F.lower("text")), "b": one(F.lower(F.substring("text", 1, 40)))}).where((F.col("a") == 1) & (F.col("b") == 1) & (F.length("text") >= 80) & (F.size(P.words(F.col("text"))) >= 8))
    return P.best_boxes(clear.select("doc_id", "sid", "text"), turns.select("doc_id", F.col("sid").alias("box_id"), "text"))


@query(f"""WITH {_PARA}, f AS (SELECT doc_id, idx, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM para WHERE regexp_matches(substr(content, 1, 30), 'th|qu')) SELECT doc_id, idx FROM f WHERE r <= 2""")
def chunks_by_section_title(t: Tables):
    return P.by_section_title(paras(t).withColumn("title", F.substring("content", 1, 30)), "th|qu", 2)


@query("SELECT p_partkey FROM part WHERE p_size % 4 IN (0, 1)")
def summary_section_chunks(t: Tables):
    title = F.element_at(F.array(F.lit("Executive Summary"), F.lit("Scope of work"), F.lit("Payment"), F.col("p_brand")), F.col("p_size") % 4 + 1)
    return P.summary_chunks(t.part.select("p_partkey", title.alias("title"))).select("p_partkey")
