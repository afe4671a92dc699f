"""Further functions and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as E
from ..operators import fulltext as FT
from ..operators import noise as N
from ..operators import segment as S
from ..sources import readers
from .registry import Tables, query
from .text_queries import _LINES, _PENALTY, _SENTENCES


@query(r"SELECT n_nationkey, 'Nation: ' || n_name || ', Region: ' || r_name || ', Key: ' || CAST(n_nationkey AS VARCHAR) AS sentence FROM nation JOIN region ON r_regionkey = n_regionkey")
def table_row_sentences(t: Tables):
    rows = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("n_nationkey", T.row_sentence(["Nation", "Region", "Key"], F.col("n_name"), F.col("r_name"), F.col("n_nationkey")).alias("sentence"))


@query(r"""SELECT item_id, unnest(regexp_extract_all(text || chr(10) || 'Total Due: ' || CAST(item_id AS VARCHAR) || ' EUR' || chr(10) || 'no pair', '(?m)^([A-Z][A-Za-z ]{1,30}): *(\S[^\n]*)$', 1)) AS key, unnest(regexp_extract_all(text || chr(10) || 'Total Due: ' || CAST(item_id AS VARCHAR) || ' EUR' || chr(10) || 'no pair', '(?m)^([A-Z][A-Za-z ]{1,30}): *(\S[^\n]*)$', 2)) AS value FROM benchmark""")
def key_value_pairs(t: Tables):
    text = F.concat("text", F.lit("\nTotal Due: "), F.col("item_id").cast("string"), F.lit(" EUR\nno pair"))
    return t.benchmark.select("item_id", F.explode(T.key_values(text)).alias("p")).select("item_id", "p.key", "p.value")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM pages""")
def html_contents(t: Tables):
    return readers.html_pages(t.pages).select("page_id", "content")


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace('../' || p_name || '/x*', '[/\\]+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g'), '[^A-Za-z0-9 ._-]', '_', 'g') AS folder FROM part")
def folder_names(t: Tables):
    return t.part.select("p_partkey", T.safe_folder(F.concat(F.lit("../"), F.col("p_name"), F.lit("/x*"))).alias("folder"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(p_name || '_part-name', '[_ -]+', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS pascal, regexp_replace(p_name || ' (a+b)', '([+!(){}^~*?:/&|-])', '\\\\\\1', 'g') AS escaped FROM part""")
def name_forms(t: Tables):
    return t.part.select("p_partkey", T.pascal_case(F.concat("p_name", F.lit("_part-name"))).alias("pascal"), T.escape_query(F.concat("p_name", F.lit(" (a+b)"))).alias("escaped"))


_WORDS = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9$% ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"""WITH s AS (SELECT conv_id, turn, {_WORDS.format("text")} AS w FROM conversations), p AS (SELECT a.conv_id * 1000 + a.turn AS claim_id, b.turn AS idx, ROUND(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / GREATEST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1), 6) AS score FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn < a.turn),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY score DESC, idx) AS r FROM p WHERE score >= 0.15) SELECT claim_id, idx, score FROM r WHERE r = 1""")
def claim_sentences(t: Tables):
    """Each turn is matched to the earlier turn of its conversation that shares the most words with it."""
    c = t.conversations
    claims = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("claim"), F.col("turn").alias("at"))
    sents = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("text").alias("sentence"))
    return E.claims(sents, claims, earlier="at")


@query(rf"""WITH {_SENTENCES}, t AS (SELECT doc_id, 'has email' AS predicate, unnest(regexp_extract_all(sentence, '{E.FIELDS["email"]}')) AS object FROM sents UNION ALL SELECT doc_id, 'has website', unnest(regexp_extract_all(sentence, '{E.FIELDS["url"]}')) FROM sents UNION ALL SELECT doc_id, 'has phone', trim(unnest(regexp_extract_all(sentence, '\+?\d[\d ()-]{{7,}}\d'))) FROM sents) SELECT DISTINCT doc_id, predicate, object FROM t""")
def letterhead_triples(t: Tables):
    return E.letterhead_triples(S.sentences(t.documents))


@query(f"WITH {_LINES} SELECT penalty, COUNT(*) AS n FROM (SELECT {_PENALTY} FROM x) p GROUP BY penalty")
def noise_filter_stats(t: Tables):
    return N.filter_stats(t.documents)


@query(r"""WITH b AS (SELECT item_id, lower(text) AS low FROM benchmark), w AS (SELECT item_id, low, list_filter(string_split(regexp_replace(replace(replace(low, 'the', ' '), 'with', ' '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3) AS words FROM b),
first AS (SELECT item_id, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE r <= 10) AS rest FROM (SELECT item_id, w, MIN(pos) AS pos, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY MIN(pos)) AS r FROM (SELECT item_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM w) x GROUP BY item_id, w) y GROUP BY item_id)
SELECT item_id, array_to_string(list_filter([CASE WHEN contains(low, 'the') THEN '"the"^2.0' END, CASE WHEN contains(low, 'with') THEN '"with"^2.0' END, rest], lambda x: x IS NOT NULL), ' ') AS phrase FROM b LEFT JOIN first USING (item_id)""")
def phrase_queries(t: Tables):
    """Known phrases first, then up to ten other words, in the order of the text."""
    q = FT.phrase_query(F.col("text"), ["the", "with"])
    return t.benchmark.select("item_id", q.alias("phrase"))
