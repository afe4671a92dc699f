"""Full-text ranking: an inverted term table and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the ranking function.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of at least 3 signs."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def bm25(documents: DataFrame, query: list[str], k: int | None = None) -> DataFrame:
    """doc_id, score (and rank, if cut to k) of documents with any query term. Only query terms are exploded, so the shuffle follows matches, not text."""
    wanted = F.array(*map(F.lit, query))
    tokens = documents.select("doc_id", terms(F.col("text")).alias("t"))
    slim = tokens.select("doc_id", F.size("t").alias("len"), F.filter("t", lambda w: F.array_contains(wanted, w)).alias("hits"))
    stats = slim.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = slim.select("doc_id", "len", F.explode("hits").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    if k is None:
        return scored
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def term_hits(documents: DataFrame, words: list[str], least: int = 1) -> DataFrame:
    """doc_id, hits: how many of the words a text contains, ignoring case and punctuation."""
    clean = F.regexp_replace(F.lower(F.col("text")), r"[^a-z0-9\s]", " ")
    hits = sum((F.contains(clean, F.lit(w)).cast("int") for w in words), F.lit(0))
    return documents.select("doc_id", hits.alias("hits")).where(F.col("hits") >= least)


def phrase_query(text: Column, phrases: list[str], most: int = 10) -> Column:
    """Known phrases in quotes with double weight, then up to `most` other words of at least 3 letters."""
    low = F.lower(text)
    named = F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(f'"{p}"^2.0')) for p in phrases]), lambda x: x.isNotNull())
    rest = low
    for p in phrases:
        rest = F.replace(rest, F.lit(p), F.lit(" "))
    return F.array_join(F.concat(named, F.slice(F.array_distinct(terms(rest)), 1, most)), " ")
