"""Layout rows. Turns of conversations stand for paragraphs, order lines for cells and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from .registry import Tables, query

_PARA = "para AS (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS idx, CASE WHEN turn % 3 = 1 THEN 'sectionHeading' ELSE 'paragraph' END AS role, substr(text, 1, 300) AS content FROM conversations)"
_SECT = f"{_PARA}, sect AS (SELECT *, SUM(CAST(role = 'sectionHeading' AS INT)) OVER w AS section, LAST_VALUE(CASE WHEN role = 'sectionHeading' THEN content END IGNORE NULLS) OVER w AS heading FROM para WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"


def paras(t: Tables):
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("bigint").alias("idx"), F.when(F.col("turn") % 3 == 1, "sectionHeading").otherwise("paragraph").alias("role"), F.substring("text", 1, 300).alias("content"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents), x AS (SELECT doc_id, unnest(range(len(p))) AS idx, unnest(p) AS content FROM l)
SELECT doc_id, idx, CASE WHEN length(content) <= 60 AND NOT regexp_matches(content, '[.!?;:,]$') THEN 'sectionHeading' ELSE 'paragraph' END AS role, content FROM x""")
def layout_paragraphs(t: Tables):
    return L.paragraphs(t.documents)


@query(rf"""WITH {_SECT} SELECT doc_id, section, MAX(heading) AS heading, COUNT(*) AS n, COALESCE(string_agg(CASE WHEN role <> 'sectionHeading' THEN content END, chr(10) ORDER BY idx), '') AS content FROM sect GROUP BY doc_id, section""")
def section_units(t: Tables):
    return L.section_units(paras(t))


@query(rf"""WITH {_SECT}, u AS (SELECT doc_id, section, list_filter(regexp_split_to_array(COALESCE(string_agg(CASE WHEN role <> 'sectionHeading' THEN content END, chr(10) ORDER BY idx), ''), '\s+'), lambda x: x <> '') AS w FROM sect GROUP BY doc_id, section),
g AS (SELECT *, SUM(CAST(len(w) >= 40 AS INT)) OVER (PARTITION BY doc_id ORDER BY section ROWS UNBOUNDED PRECEDING) AS g FROM u), j AS (SELECT doc_id, MIN(section) AS first_section, flatten(list(w ORDER BY section)) AS w FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, first_section, w, unnest(range(GREATEST(CAST(ceil((len(w) - 10) / 50.0) AS INT) - 1, 0) + 1)) AS piece FROM j WHERE len(w) > 0)
SELECT doc_id, first_section, piece, len(w[piece * 50 + 1 : piece * 50 + 60]) AS n_words, array_to_string(w[piece * 50 + 1 : piece * 50 + 60], ' ') AS content FROM c""")
def chunk_rules(t: Tables):
    return L.chunk_rules(L.section_units(paras(t)), 40, 60, 10)


@query("""SELECT s_nationkey AS doc_id, 0 AS table_id, 'name|balance' AS headers, string_agg(s_name || ',' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), '|' ORDER BY s_suppkey) AS rows, COUNT(*) AS n_rows FROM supplier GROUP BY s_nationkey""")
def table_metadata(t: Tables):
    cell = lambda row, col, text: F.struct(row.cast("bigint").alias("row"), F.lit(col).alias("col"), text.alias("text"))
    body = t.supplier.select(F.col("s_nationkey").alias("doc_id"), F.explode(F.array(cell(F.col("s_suppkey") + 1, 0, F.col("s_name")), cell(F.col("s_suppkey") + 1, 1, F.floor("s_acctbal").cast("string")))).alias("c"))
    head = t.supplier.select(F.col("s_nationkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(cell(F.lit(0), 0, F.lit("name")), cell(F.lit(0), 1, F.lit("balance")))).alias("c"))
    found = L.tables(body.unionAll(head).select("doc_id", F.lit(0).alias("table_id"), "c.*"))
    return found.select("doc_id", "table_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "|").alias("rows"), "n_rows")


@query("""WITH b AS (SELECT p_partkey AS doc_id, unnest([{'kind': 'UPC-A', 'value': CAST(p_partkey AS VARCHAR)}, {'kind': 'QRCode', 'value': CASE WHEN p_size % 2 = 0 THEN 'https://x.org/' || CAST(p_partkey AS VARCHAR) ELSE p_name END}, {'kind': 'Code128', 'value': CASE WHEN p_size % 3 = 0 THEN '1Z' || lpad(CAST(p_partkey AS VARCHAR), 16, '0') WHEN p_size % 3 = 1 THEN lpad(CAST(p_partkey AS VARCHAR), 20, '0') ELSE p_brand END}, {'kind': 'PDF417', 'value': CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END}, {'kind': 'Aztec', 'value': p_type}]) AS b FROM part)
SELECT doc_id, b.kind AS kind, b.value AS value, CASE b.kind WHEN 'UPC-A' THEN 'PRODUCT_CODE' WHEN 'QRCode' THEN CASE WHEN b.value LIKE 'http%' THEN 'URL' ELSE 'QR_DATA' END WHEN 'Code128' THEN CASE WHEN regexp_matches(b.value, '^(1Z.{16}|[0-9]{20})$') THEN 'TRACKING_NUMBER' ELSE 'BARCODE' END WHEN 'PDF417' THEN 'DOCUMENT_ID' ELSE 'BARCODE' END AS entity_type FROM b WHERE b.value <> ''""")
def barcode_entities(t: Tables):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    code = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    parcel = F.when(size % 3 == 0, F.concat(F.lit("1Z"), F.lpad(key, 16, "0"))).when(size % 3 == 1, F.lpad(key, 20, "0")).otherwise(F.col("p_brand"))
    codes = F.array(code("UPC-A", key), code("QRCode", F.when(size % 2 == 0, F.concat(F.lit("https://x.org/"), key)).otherwise(F.col("p_name"))), code("Code128", parcel), code("PDF417", F.when(size % 5 == 0, "").otherwise(F.col("p_brand"))), code("Aztec", F.col("p_type")))
    return L.barcodes(t.part.select(F.col("p_partkey").alias("doc_id"), codes.alias("barcodes")))


@query("SELECT l_orderkey AS doc_id, COUNT(*) FILTER (l_returnflag = 'R') AS selected, COUNT(*) FILTER (l_returnflag = 'N') AS unselected FROM lineitem GROUP BY l_orderkey")
def selection_marks(t: Tables):
    state = F.when(F.col("l_returnflag") == "R", "selected").when(F.col("l_returnflag") == "N", "unselected").otherwise("unknown")
    return L.selection_marks(t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(state).alias("marks")))


@query(f"""WITH {_SECT}, f AS (SELECT DISTINCT doc_id, doc_id * 10 AS figure_id, 'Figure ' || CAST(doc_id AS VARCHAR) AS caption FROM para), e AS (SELECT *, unnest([1, 4, 99]) AS idx FROM f)
SELECT e.doc_id, figure_id, caption, COALESCE(array_to_string(list_sort(list(DISTINCT section) FILTER (section IS NOT NULL)), ','), '') AS sections FROM e LEFT JOIN sect ON sect.doc_id = e.doc_id AND sect.idx = e.idx GROUP BY e.doc_id, figure_id, caption""")
def figure_sections(t: Tables):
    rows = paras(t)
    own = F.array(F.struct((F.col("doc_id") * 10).alias("id"), F.concat(F.lit("Figure "), F.col("doc_id").cast("string")).alias("caption"), F.array(*[F.lit(i).cast("bigint") for i in (1, 4, 99)]).alias("elements")))
    return L.figures(rows.select("doc_id").distinct().select("doc_id", own.alias("figures")), rows).withColumn("sections", F.array_join(F.transform("sections", lambda x: x.cast("string")), ","))


_LINES = "lines AS (SELECT p_size AS doc_id, ROW_NUMBER() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS idx, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Signed by ' || p_name WHEN p_partkey % 13 = 0 THEN 'Date: 2024' ELSE p_name END AS content FROM part)"


def _lines(t: Tables):
    from pyspark.sql import Window

    key = F.col("p_partkey")
    content = F.when(key % 11 == 0, F.concat(F.lit("Signed by "), F.col("p_name"))).when(key % 13 == 0, "Date: 2024").otherwise(F.col("p_name"))
    return t.part.select(F.col("p_size").alias("doc_id"), (F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1).cast("bigint").alias("idx"), content.alias("content"))


@query(f"""WITH {_LINES}, n AS (SELECT *, MAX(CAST(regexp_matches(content, '(?i)\\b(signed by|date:)') AS INT)) OVER (PARTITION BY doc_id ORDER BY idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines), h AS (SELECT *, CAST(idx - LAG(idx, 1, -10) OVER (PARTITION BY doc_id ORDER BY idx) > 1 AS INT) AS gap FROM n WHERE near = 1),
b AS (SELECT *, SUM(gap) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS block FROM h) SELECT doc_id, block, MIN(idx) AS first, MAX(idx) AS last, COUNT(*) AS lines FROM b GROUP BY doc_id, block""")
def signature_blocks(t: Tables):
    return L.signature_blocks(_lines(t))


_WORDS = "words AS (SELECT s_nationkey AS doc_id, s_suppkey AS id, 10 * r AS start, 10 * r + 8 AS \"end\", (r % 7) * 0.1 AS x0, (r // 7) * 0.02 AS y0, (r % 7) * 0.1 + 0.08 AS x1, (r // 7) * 0.02 + 0.01 AS y1 FROM (SELECT s_nationkey, s_suppkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier))"
_SPANS = "spans AS (SELECT doc_id, g AS id, g * 45 AS start, g * 45 + 40 AS \"end\" FROM (SELECT DISTINCT s_nationkey AS doc_id FROM supplier), (SELECT unnest(range(6)) AS g))"


def _words(t: Tables):
    from pyspark.sql import Window

    r = (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("bigint")
    rows = t.supplier.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("id"), r.alias("r"))
    x, y = F.col("r") % 7, F.floor(F.col("r") / 7)
    return rows.select("doc_id", "id", (10 * F.col("r")).alias("start"), (10 * F.col("r") + 8).alias("end"), (x * 0.1).alias("x0"), (y * 0.02).alias("y0"), (x * 0.1 + 0.08).alias("x1"), (y * 0.02 + 0.01).alias("y1"))


def _spans(t: Tables):
    return t.supplier.select(F.col("s_nationkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("id")).select("doc_id", "id", (F.col("id") * 45).alias("start"), (F.col("id") * 45 + 40).alias("end"))


@query(f"""WITH {_WORDS}, {_SPANS}, m AS (SELECT w.*, s.id AS sentence_id FROM spans s JOIN words w ON s.doc_id = w.doc_id AND w.start < s."end" AND w."end" > s.start), n AS (SELECT *, COALESCE(CAST(y0 - LAG(y0) OVER (PARTITION BY doc_id, sentence_id ORDER BY start, id) > 0.015 AS INT), 0) AS new FROM m),
l AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id, sentence_id ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS line FROM n) SELECT doc_id, sentence_id, line, CAST(MIN(x0) AS DOUBLE) AS x0, CAST(MIN(y0) AS DOUBLE) AS y0, CAST(MAX(x1) AS DOUBLE) AS x1, CAST(MAX(y1) AS DOUBLE) AS y1 FROM l GROUP BY doc_id, sentence_id, line""")
def sentence_boxes(t: Tables):
    return L.sentence_boxes(_spans(t), _words(t))


@query(f"WITH {_WORDS} SELECT doc_id, CAST(MIN(x0) AS DOUBLE) AS x0, CAST(MIN(y0) AS DOUBLE) AS y0, CAST(MAX(x1) AS DOUBLE) AS x1, CAST(MAX(y1) AS DOUBLE) AS y1 FROM words GROUP BY doc_id")
def merged_polygons(t: Tables):
    return L.box(_words(t), ["doc_id"])


@query(f"""WITH {_WORDS}, {_SPANS} SELECT w.doc_id, w.id AS sentence_id, s.id % 3 + 1 AS page FROM words w JOIN spans s ON s.doc_id = w.doc_id AND w.start >= s.start AND w.start < s."end" """)
def sentence_pages(t: Tables):
    return L.page_of(_words(t).select("doc_id", "id", "start"), _spans(t).withColumn("page", F.col("id") % 3 + 1))


@query(rf"""WITH {_PARA}, m AS (SELECT *, MAX(CAST(role = 'sectionHeading' OR length(content) > 200 AS INT)) OVER w AS stopped, COUNT(*) OVER w AS n, SUM(len(regexp_split_to_array(trim(content, ' '), '\s+'))) OVER w AS words FROM para WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) SELECT doc_id, idx FROM m WHERE stopped = 0 AND n <= 5 AND words <= 50""")
def letterhead_lines(t: Tables):
    return L.letterhead(paras(t))


@query("SELECT n_nationkey, 'Signed, ' || n_name || '. Region ' || CAST(n_regionkey AS VARCHAR) AS sentence FROM nation")
def signature_sentences(t: Tables):
    lines = F.array(F.concat(F.lit(" Signed, "), F.col("n_name")), F.lit("______"), F.lit("Title:"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")), F.lit(" "))
    return t.nation.select("n_nationkey", L.signature_sentence(lines).alias("sentence"))
