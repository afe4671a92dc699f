"""Vector and full-text search, ranking, fusion and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext as FT
from ..operators import ranking as R
from ..operators import vector as V
from . import fixture as X
from .fixture import SENTENCES
from .registry import SQL, Tables, query

_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_SCORED = f"scored AS (SELECT b.vec_id AS query_id, a.vec_id, a.label, ROUND({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0)"


def _queries(t: Tables):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"WITH {_SCORED} SELECT query_id, vec_id, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) x WHERE rank <= 10")
def vector_top_k(t: Tables):
    """Queries are all vectors whose id is divisible by 20, against all vectors."""
    return V.top_k(_queries(t), t.embeddings, 10)


@query(f"WITH {_SCORED} SELECT query_id, vec_id, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score >= 0.45) x WHERE rank <= 8")
def vector_threshold(t: Tables):
    return V.top_k(_queries(t), t.embeddings, 8, least=0.45)


@query(f"WITH {_SCORED}, fan AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, label < 5 ORDER BY score DESC, vec_id) AS r FROM scored) x WHERE r <= 5) SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fan) y WHERE rank <= 5")
def tenant_union_search(t: Tables):
    """Top k in the own tenant and in the shared one (by label), then of both."""
    both = V.top_k(_queries(t), t.embeddings.where("label < 5"), 5).unionAll(V.top_k(_queries(t), t.embeddings.where("label >= 5"), 5)).drop("rank")
    return R.top_per_group(both, ["query_id"], [F.desc("score"), F.col("vec_id")], 5)


_PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, ROUND({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"WITH {_PAIRS} SELECT a, b, score FROM pairs WHERE score >= 0.65")
def synonymy_edges(t: Tables):
    return V.similar_pairs(t.embeddings, 0.65)


@query(f"""WITH {_PAIRS}, e AS (SELECT a, b, score FROM pairs WHERE score >= 0.5), x AS (SELECT a AS own, b AS other, score FROM e UNION ALL SELECT b, a, score FROM e), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY own ORDER BY score DESC, other) AS r FROM x)
SELECT LEAST(own, other) AS a, GREATEST(own, other) AS b, MAX(score) AS score FROM r WHERE r <= 2 GROUP BY 1, 2 HAVING COUNT(*) = 2""")
def mutual_knn_edges(t: Tables):
    return V.capped_edges(V.similar_pairs(t.embeddings, 0.5), 2)


@query(f"""WITH {_PAIRS}, e AS (SELECT a, b, score FROM pairs WHERE score >= 0.43 AND la <> lb), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM e) SELECT a, b, score FROM r WHERE r <= 5""")
def cross_document_similarity(t: Tables):
    label = t.embeddings.select("vec_id", "label")
    pairs = V.similar_pairs(t.embeddings, 0.43).join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la <> lb")
    return R.top_per_group(pairs.select("a", "b", "score"), ["a"], [F.desc("score"), F.col("b")], 5, "r").drop("r")


@query("""WITH r AS (SELECT o_totalprice AS v, ROW_NUMBER() OVER (ORDER BY o_totalprice) AS k, COUNT(*) OVER () AS n FROM orders), s AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS share)
SELECT CAST(share AS DOUBLE) AS share, MIN(v) AS value FROM s JOIN r ON k >= GREATEST(1, ceil(ROUND(CAST(share AS DOUBLE) * n, 9))) GROUP BY share""")
def nearest_rank_percentiles(t: Tables):
    return V.nearest_rank(t.orders, "o_totalprice", [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])


_WORDS = ["the", "tion", "ing", "que", "der", "apache"]
_BM = """tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS t FROM documents), st AS (SELECT COUNT(*) AS n_docs, AVG(len(t)) AS avg_len FROM tok),
ex AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok), tf AS (SELECT doc_id, len, term, COUNT(*) AS tf FROM ex WHERE term IN ('the', 'que', 'der', 'apache') GROUP BY doc_id, len, term), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, ROUND(SUM(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)"""
_QUERY = ["the", "que", "der", "apache"]


@query(f"WITH {_BM} SELECT doc_id, score, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 30")
def bm25_top_k(t: Tables):
    return FT.bm25(t.documents, _QUERY, 30)


_HYBRID = f"""{_BM}, f AS (SELECT * FROM (SELECT doc_id AS id, score, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm) x WHERE rank <= 30), {_SCORED},
v AS (SELECT * FROM (SELECT vec_id AS id, score, ROW_NUMBER() OVER (ORDER BY score DESC, vec_id) AS rank FROM scored WHERE query_id = 0) x WHERE rank <= 30)"""


def _legs(t: Tables):
    f = FT.bm25(t.documents, _QUERY, 30).withColumnRenamed("doc_id", "id")
    v = V.top_k(_queries(t).where("query_id = 0"), t.embeddings, 30).withColumnRenamed("vec_id", "id")
    return f, v


@query(f"WITH {_HYBRID} SELECT id, ROUND(SUM(1.0 / (60 + rank)), 8) AS score, COUNT(*) AS hits FROM (SELECT id, rank FROM f UNION ALL SELECT id, rank FROM v) x GROUP BY id")
def hybrid_rrf(t: Tables):
    return R.rrf(*_legs(t))


@query(f"""WITH {_HYBRID}, fs AS (SELECT id, (score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()) * 0.4 AS s FROM f), vs AS (SELECT id, (score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()) * 0.6 AS s FROM v)
SELECT id, ROUND(SUM(s), 6) AS score FROM (SELECT id, s FROM fs UNION ALL SELECT id, s FROM vs) x GROUP BY id""")
def hybrid_weighted(t: Tables):
    f, v = _legs(t)
    return R.weighted((f, 0.4), (v, 0.6))


@query(r"""WITH h AS (SELECT doc_id, """ + " + ".join(f"CAST(contains(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '{w}') AS INTEGER)" for w in _WORDS) + """ AS hits FROM documents) SELECT doc_id, hits FROM h WHERE hits >= 2""")
def keyword_boost(t: Tables):
    return FT.term_hits(t.documents, _WORDS, least=2)


@query(f"""WITH {SENTENCES}, r AS (SELECT sid, doc_id, idx, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY idx) AS rank FROM sent) SELECT sid, doc_id, idx, ROW_NUMBER() OVER (ORDER BY rank, doc_id) AS position FROM r WHERE rank <= 2 ORDER BY rank, doc_id LIMIT 20""")
def coverage_round_robin(t: Tables):
    return R.round_robin(X.sentences(t).select("sid", "doc_id", "idx"), "doc_id", [F.col("idx")], 2, 20)


@query(f"WITH {SENTENCES} SELECT sid, doc_id, rank FROM (SELECT sid, doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS rank FROM sent) x WHERE rank <= 3")
def best_per_document(t: Tables):
    return R.top_per_group(X.sentences(t), ["doc_id"], [F.desc("score"), F.col("sid")], 3).select("sid", "doc_id", "rank")


@query(f"""WITH {SENTENCES}, a AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY score DESC, sid) AS r FROM sent) x WHERE r <= 3), b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS r2 FROM a) x WHERE r2 <= 2)
SELECT sid, section_id, doc_id FROM b ORDER BY score DESC, sid LIMIT 25""")
def section_and_document_caps(t: Tables):
    return R.two_caps(X.sentences(t), [F.desc("score"), F.col("sid")], [("section_id", 3), ("doc_id", 2)], 25).select("sid", "section_id", "doc_id")


@query(f"""WITH {SENTENCES}, x AS (SELECT sid AS id, doc_id, score, MAX(score) OVER (PARTITION BY doc_id) AS best, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS r, MAX(score) OVER () AS top FROM sent)
SELECT id, doc_id, score FROM x ORDER BY CASE WHEN best >= 0.85 * top AND r <= 2 THEN 1 ELSE 0 END DESC, score DESC, id LIMIT 40""")
def diversified_by_document(t: Tables):
    return R.diversify(X.sentences(t).select(F.col("sid").alias("id"), "doc_id", "score"), 40)


@query(f"WITH {SENTENCES}, b AS (SELECT doc_id, MAX(score) AS best FROM sent GROUP BY doc_id) SELECT sid, doc_id FROM sent WHERE doc_id IN (SELECT doc_id FROM b WHERE best >= 0.9 * (SELECT MAX(best) FROM b))")
def near_best_documents(t: Tables):
    return R.near_best(X.sentences(t)).select("sid", "doc_id")


@query(f"""WITH {SENTENCES}, s AS (SELECT doc_id AS id, ROUND(SUM(score * score) / 1e9, 4) AS score FROM sent GROUP BY doc_id), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS rank, LAG(score) OVER (ORDER BY score DESC, id) AS prev FROM s),
c AS (SELECT *, SUM(CASE WHEN rank > 6 AND score < 0.5 * prev THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cut FROM r) SELECT id, score, rank FROM c WHERE cut = 0""")
def score_gap_all_documents(t: Tables):
    return R.gap_prune(X.sentences(t).groupBy(F.col("doc_id").alias("id")).agg(F.round(F.sum(F.col("score") * F.col("score")) / 1e9, 4).alias("score")))


query(SQL["score_gap_all_documents"], name="score_gap_prune")(score_gap_all_documents)


@query("""WITH r AS (SELECT doc_id, source, n_chars // 4 AS cost, CAST(SUM(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) SELECT doc_id, source, running FROM r WHERE running <= 8000""")
def context_budget(t: Tables):
    rows = t.documents.select("doc_id", "source", F.floor(F.col("n_chars") / 4).alias("cost"))
    return R.within_budget(rows, "source", [F.col("doc_id")], "cost", 8000).select("doc_id", "source", "running")
