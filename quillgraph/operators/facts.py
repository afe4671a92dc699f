"""Facts from rules, checks of extracted values, and the seams where a model may stand.

A seam takes and returns columns; the default is a rule, so that jobs run and
are tested without a model. A caller passes a function of its own for one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import words_of
from .iterate import durable
from .segment import split_sentences

# Endings of organisations, words of an unclear question, and what they add.
ORGANISATION = r"\b[A-Z][A-Za-z&]*(?: [A-Z][A-Za-z&]*)* (?:Inc|LLC|Ltd|Corp|Corporation|Company|GmbH)\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"
VAGUE = ("our", "the main", "primary", "key", "important", "significant", "top", "major", "leading")
SCOPE = ("all related", "everything about", "anything to do with", "overall", "in general", "broadly")
COMPARING = ("compare", "versus", "vs", "difference between", "better", "worse", "more than", "less than")

Seam = Callable[[Column], Column]


def named_entities(text: Column) -> Column:
    """Runs of 2 to 4 capitalised words: the default extractor."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"), F.lit(0)))


def entities(chunks: DataFrame, extract: Seam = named_entities) -> DataFrame:
    """key, name, kind, chunks, first: entities of chunks (chunk_id, text): the first name of each canonical key, and where it stands."""
    rows = chunks.select("chunk_id", F.explode(extract(F.col("text"))).alias("name")).withColumn("key", T.canonical_key(F.col("name"))).where("key <> ''")
    out = rows.groupBy("key").agg(F.min(F.struct("chunk_id", "name")).alias("f"), F.countDistinct("chunk_id").alias("chunks"))
    return out.select("key", F.col("f.name").alias("name"), F.lit("CONCEPT").alias("kind"), "chunks", F.col("f.chunk_id").alias("first"))


def triples_of(chunks: DataFrame, extract: Seam = named_entities) -> DataFrame:
    """chunk_id, subject, predicate, object: neighbours among the entities of one chunk, in the order of the text."""
    found = chunks.select("chunk_id", F.posexplode(extract(F.col("text"))).alias("at", "name"))
    nxt = F.lead("name").over(Window.partitionBy("chunk_id").orderBy("at"))
    return found.withColumn("object", nxt).where("object is not null").select("chunk_id", F.col("name").alias("subject"), F.lit("stands with").alias("predicate"), "object")


def summary(text: Column, sentences: int = 2, most: int = 300) -> Column:
    """The first sentences of a text, cut to `most` signs: the default summary."""
    return F.substring(F.array_join(F.slice(split_sentences(text), 1, sentences), " "), 1, most)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has: the default relevance."""
    q = words_of(query)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, words_of(text))) / F.size(q), 6)).otherwise(0.0)


def reranked(rows: DataFrame, k: int, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """query_id, id, relevance, rank: the k most relevant of (query_id, query, id, text) for each query."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id"))
    return rows.withColumn("relevance", score(F.col("query"), F.col("text"))).withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "id", "relevance", "rank")


def relevant(rows: DataFrame, least: float, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """Rows (query_id, query, id, text) of at least `least` relevance; a query of which none is left keeps all, and so do rows whose score is null."""
    scored = rows.withColumn("s", score(F.col("query"), F.col("text"))).withColumn("ok", F.coalesce(F.col("s") >= least, F.lit(True)))
    any_ = F.max("ok").over(Window.partitionBy("query_id"))
    return scored.withColumn("any", any_).where(F.col("ok") | ~F.col("any")).drop("s", "ok", "any")


def answers(claims: DataFrame, most: int = 2) -> DataFrame:
    """query_id, answer, parts: up to `most` partial answers (query_id, id, text) joined by blank lines; of more, the first."""
    rows = claims.where(F.trim("text") != "").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "text")))["text"].alias("t"))
    return rows.select("query_id", F.when(F.size("t") <= most, F.array_join("t", "\n\n")).otherwise(F.col("t")[0]).alias("answer"), F.size("t").alias("parts"))


def prompts(blocks: DataFrame, budget: int) -> DataFrame:
    """query_id, prompt, n: blocks (query_id, kind, id, text) in order of kind and id while their characters stay within the budget, numbered, one a line."""
    w = Window.partitionBy("query_id").orderBy("kind", "id")
    rows = blocks.withColumns({"used": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w)}).where(F.col("used") <= budget)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("text"))
    return rows.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", line.alias("t"))))["t"], "\n").alias("prompt"), F.count(F.lit(1)).alias("n"))


def citation_list(rows: DataFrame, preview: int = 100) -> DataFrame:
    """query_id, number, id, preview: citations numbered by score, each with the beginning of its text."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.select("query_id", F.row_number().over(w).alias("number"), "id", F.substring("text", 1, preview).alias("preview"))


def evidence_counts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, n: passages of each sub-question, 0 where it has none."""
    n = evidence.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return questions.select("question_id").join(n, "question_id", "left").fillna(0, ["n"])


def signature_triples(lines: DataFrame) -> DataFrame:
    """doc_id, subject, predicate, object of signature lines (doc_id, text) that read `name / role / date`, in any order of the last two."""
    part = F.filter(F.transform(F.split("text", r"\s*/\s*"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select("doc_id", part.alias("p")).where(F.size("p") >= 2).select("doc_id", F.col("p")[0].alias("subject"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("x"))
    is_date = F.col("x").rlike(DATE)
    signed = rows.select("doc_id", "subject", F.when(is_date, "signed on").otherwise("signed as").alias("predicate"), F.col("x").alias("object"))
    return signed.unionAll(rows.select("doc_id", "subject", F.lit("is signatory"), F.col("doc_id").cast("string")).distinct())


def block_triples(blocks: DataFrame) -> DataFrame:
    """doc_id, subject, predicate, object of signature blocks (doc_id, text): organisations by their ending sign, on the block's dates, and with each other."""
    orgs = blocks.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ORGANISATION), F.lit(0)))).alias("subject"))
    dated = orgs.select("doc_id", "subject", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(DATE), F.lit(0)))).alias("object")).select("doc_id", "subject", F.lit("signed on").alias("predicate"), "object")
    a, b = orgs.select("doc_id", "subject"), orgs.select("doc_id", F.col("subject").alias("object"))
    return dated.unionAll(a.join(b, "doc_id").where("subject < object").distinct().select("doc_id", "subject", F.lit("co-signed with"), "object"))


#: Most variants of names that are broadcast.
FEW_VARIANTS = 20_000


def mentioned(entities_: DataFrame, texts: DataFrame) -> DataFrame:
    """id, name: entities (name, aliases) of which the name, an alias or a run of two and more of its words, of 4 signs at least, stands in a text (id, text), word for word.

    Variants meet texts on their first word, so that every text is only compared with names that can stand in it. Up to
    FEW_VARIANTS variants are broadcast; of more, both sides are sorted. The words of the texts are never broadcast,
    though Spark takes them for as small as the file.
    """
    w = F.split("name", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.size(w), F.lit(2))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))
    variants = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.size(w) > 2, runs).otherwise(F.array().cast("array<string>"))))
    v = entities_.select("name", F.explode(F.transform(variants, lambda x: T.canonical_key(x))).alias("v")).where(F.length("v") >= 4).distinct().withColumn("k", F.substring_index("v", " ", 1))
    t = texts.select("id", T.canonical_key(F.col("text")).alias("t"))
    keys = t.withColumn("k", F.explode(F.array_distinct(F.split("t", " "))))
    v = durable(v)
    if v.limit(FEW_VARIANTS + 1).count() <= FEW_VARIANTS:
        met = keys.join(F.broadcast(v), "k")
    else:
        met = keys.select(F.col("id").alias("at"), "k").join(v.hint("merge"), "k").distinct().join(t.hint("merge"), F.col("at").eqNullSafe(F.col("id")))
    return met.where(F.concat(F.lit(" "), F.col("t"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("v"), F.lit(" ")))).select("id", "name").distinct()


def commit_gate(counts: DataFrame, entities_: int = 3, relations: int = 5) -> DataFrame:
    """group_id, entities, relations, commit: whether a group's extraction is enough to be kept."""
    return counts.withColumn("commit", (F.col("entities") >= entities_) & (F.col("relations") >= relations))


def confidence(found: Column, required: list[str], optional: list[str]) -> Column:
    """0.7 of the share of required fields that a map fills, and 0.3 of that of the optional ones; a group without fields counts as filled."""

    def share(names: list[str]) -> Column:
        return sum((F.coalesce(F.trim(found[n]) != "", F.lit(False)).cast("double") for n in names), F.lit(0.0)) / len(names) if names else F.lit(1.0)

    return F.round(0.7 * share(required) + 0.3 * share(optional), 2)


def schema_fields(schema: dict, prefix: str = "") -> list[tuple[str, str, bool]]:
    """(path, type, required) of every leaf of a JSON schema; arrays have `[]` after their name."""
    out = []
    for name, part in (schema.get("properties") or {}).items():
        path, kind = f"{prefix}{name}", part.get("type", "string")
        inner = part.get("items") or {} if kind == "array" else part
        if inner.get("properties"):
            out += schema_fields(inner, f"{path}[]." if kind == "array" else f"{path}.")
        else:
            out.append((f"{path}[]" if kind == "array" else path, inner.get("type", "string"), name in (schema.get("required") or [])))
    return out


def valid(rows: DataFrame, column: str, ddl: str, required: list[str]) -> DataFrame:
    """Adds `valid`: whether a JSON text reads as the schema and has all required fields."""
    parsed = F.from_json(column, ddl)
    ok = F.try_parse_json(column).isNotNull()
    for name in required:
        ok = ok & parsed[name].isNotNull()
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def comparison_lines(text: Column) -> Column:
    """(field, left, right, verdict) of every line that reads `field | left | right | MATCH or DIFFERENT`."""
    line = r"(?im)^\s*([^|\n]+?)\s*\|\s*([^|\n]*?)\s*\|\s*([^|\n]*?)\s*\|\s*(match|different)\s*$"
    part = lambda i: F.regexp_extract_all(text, F.lit(line), F.lit(i))
    return F.arrays_zip(part(1).alias("field"), part(2).alias("left"), part(3).alias("right"), F.transform(part(4), lambda v: F.upper(v)).alias("verdict"))


def _hits(low: Column, phrases: tuple[str, ...], worth: float) -> Column:
    return sum((low.contains(p).cast("double") * worth for p in phrases), F.lit(0.0))


def ambiguity(question: Column) -> Column:
    """0 to 1: 0.15 for each vague word, 0.2 for each word of wide scope or comparison; less 0.15 for one capitalised word after the first, 0.3 for more, and 0.2 for a quotation mark."""
    low = F.lower(question)
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    proper = F.size(F.filter(F.slice(words, 2, 1 << 30), lambda w: w.rlike(r"(?s)^\p{Lu}.")))
    named = F.when(proper >= 2, 0.3).when(proper == 1, 0.15).otherwise(0.0)
    quoted = F.when(question.rlike("[\"']"), 0.2).otherwise(0.0)
    score = _hits(low, VAGUE, 0.15) + _hits(low, SCOPE, 0.2) + _hits(low, COMPARING, 0.2) - named - quoted
    return F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 6)


def has_explicit_entity(question: Column) -> Column:
    """A capitalised word after the first, something in quotes, or an identifier such as INV-2024."""
    return question.rlike(r"\S\s+[A-Z][a-z]") | question.rlike(r"[\"'][^\"']{2,}[\"']") | question.rlike(r"\b[A-Z]{2,}-?\d+\b")


def parts_of(question: Column) -> Column:
    """Sub-questions: the default cuts at `and`, semicolons and question marks."""
    return F.filter(F.transform(F.split(question, r"(?i)\s+and\s+|;\s*|\?\s*"), lambda x: F.trim(x)), lambda x: x != "")


def hashed_vector(text: Column, width: int = 64) -> Column:
    """The default embedding: signed counts of hashed words at unit length; only a text without words is all zeros.

    Where all signs cancel each other, the counts stand without signs.
    """

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), width))
        for row, t in zip(out, texts.to_pylist(), strict=True):
            keys = np.array([zlib.crc32(w.encode()) for w in set(re.findall("[a-z0-9$%]+", (t or "").lower()))], np.int64)
            np.add.at(row, keys % width, np.where(keys >> 31 & 1, -1.0, 1.0))
            if not row.any():
                np.add.at(row, keys % width, 1.0)
        norm = np.linalg.norm(out, axis=1)[:, None]
        out /= np.where(norm > 0, norm, 1)
        return pa.array(list(out), pa.list_(pa.float64()))

    return vector(text)


def embedded(rows: DataFrame, text: Column, embed: Seam = hashed_vector) -> DataFrame:
    """Adds `embedding` and `text_hash`; every distinct text is embedded once."""
    marked = rows.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    made = marked.select("text_hash", F.coalesce(text, F.lit("")).alias("__text")).dropDuplicates(["text_hash"]).select("text_hash", embed(F.col("__text")).alias("embedding"))
    return marked.join(made, "text_hash")


def stale_vectors(rows: DataFrame, width: int, text: Column) -> DataFrame:
    """Rows (text_hash, embedding) whose vector is missing, of another width, or of another text."""
    return rows.where(F.col("embedding").isNull() | (F.size("embedding") != width) | ~F.col("text_hash").eqNullSafe(F.sha2(F.coalesce(text, F.lit("")), 256)))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (text_hash) with the result that a cache (text_hash, result) has, and those without one."""
    return requests.join(cache, "text_hash"), requests.join(cache.select("text_hash"), "text_hash", "left_anti")
