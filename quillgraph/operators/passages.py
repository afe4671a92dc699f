"""Cutting, joining and batching of texts: what comes before and after sentence splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cuts import greedy
from .iterate import durable


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def plain_text(c: Column) -> Column:
    """A chunk of marked text as prose: tables, comments, headings, figures, list marks and signature blocks go; a paragraph's end becomes a full stop, a line's end a blank."""
    out = c
    for pattern in (r"(?is)<figure\b.*?</figure>", r"(?s)<!--.*?-->", r"(?is)<table\b.*?</table>", r"(?m)^\|.*\|\s*$", r"(?m)^#{1,6}\s.*$", r"(?m)^\s*(?:[-*•]|\d+[.)])\s+", r"(?is)\n\s*(?:in witness whereof|signed by)\b.*$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"^\s+|\s+$", ""), r"\s*\n\s*\n\s*", "\u0001")
    out = F.regexp_replace(out, r"([.!?:])\u0001", "$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\u0001", ". "), r"\s+", " "))


def joined_pairs(lines: DataFrame, short: int = 15, most: int = 120) -> DataFrame:
    """doc_id, idx, n, text: runs of neighbouring `Key: value` lines of at most `short` words are one line, joined by ` | `.

    A line that would take a joined one over `most` words begins the next; a line that is no pair is a run of its own.
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    pair = F.col("text").rlike(r"^[^:]{1,60}:\s*\S") & (F.size(words(F.col("text"))) <= short)
    rows = lines.withColumns({"pair": pair, "n": F.size(words(F.col("text")))})
    rows = rows.withColumn("new", (~F.col("pair") | ~F.coalesce(F.lag("pair").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = greedy(rows.select("doc_id", "run", "idx", "n", "text"), ["doc_id", "run"], ["idx"], F.col("n"), most)
    text = F.array_join(F.sort_array(F.collect_list(F.struct("idx", "text")))["text"], " | ")
    return rows.groupBy("doc_id", "run", "piece").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n"), text.alias("text")).select("doc_id", "idx", "n", "text")


def same_text(before: Column, after: Column) -> Column:
    """Whether two arrays of sentences differ in their boundaries only."""
    return F.concat_ws("", before) == F.concat_ws("", after)


def split_large(units: DataFrame, most: int = 1500, overlap: int = 50) -> DataFrame:
    """doc_id, piece, text: texts are cut at blank lines into pieces of at most `most` words.

    A paragraph that would take its piece over the limit begins the next one, which repeats the last `overlap` words of
    the piece before, if that has more; they count. A single paragraph is not cut.
    """
    paras = F.filter(F.transform(F.split("text", r"\n\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = units.select("doc_id", F.posexplode(paras).alias("at", "p"))
    cut = durable(greedy(rows, ["doc_id"], ["at"], F.size(words(F.col("p"))), most, overlap=overlap))
    body = cut.groupBy("doc_id", "piece").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "p")))["p"], "\n\n").alias("body"), F.max("repeats").alias("repeats"), F.min("place").alias("begin"))
    # what a piece repeats stands in the `overlap` paragraphs before it, and not before the last piece that repeats nothing
    own = Window.partitionBy("doc_id").orderBy("piece")
    body = body.withColumn("since", F.last(F.when(~F.col("repeats"), F.col("begin")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    before = body.where("repeats").select("doc_id", "piece", F.explode(F.sequence(F.greatest("since", F.col("begin") - overlap), F.col("begin") - 1)).alias("place"))
    near = before.join(cut.select("doc_id", "place", F.slice(words(F.col("p")), -overlap, overlap).alias("all"), words(F.col("p")).alias("w")), ["doc_id", "place"])
    last = near.groupBy("doc_id", "piece").agg(F.flatten(F.sort_array(F.collect_list(F.struct("place", F.when(F.size("w") > overlap, F.col("all")).otherwise(F.col("w")).alias("w"))))["w"]).alias("w"))
    tail = last.select("doc_id", "piece", F.array_join(F.slice("w", F.greatest(F.size("w") - overlap + 1, F.lit(1)), overlap), " ").alias("tail"))
    out = body.join(tail, ["doc_id", "piece"], "left")
    return out.select("doc_id", "piece", F.when(F.col("tail").isNotNull(), F.concat("tail", F.lit("\n\n"), F.col("body"))).otherwise(F.col("body")).alias("text"))


def slices(documents: DataFrame, most: int) -> DataFrame:
    """doc_id, piece, text: fixed slices of `most` characters; an empty text has none."""
    n = F.ceil(F.length("text") / most).cast("int")
    rows = documents.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return rows.select("doc_id", "piece", F.substr("text", F.col("piece") * most + 1, F.lit(most)).alias("text"))


def halves(documents: DataFrame, most: int, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, text: texts of more than `most` tokens are halved at the blank next after their middle, again and again.

    Each level splits what is still too long and is written out, so there are as many levels as the longest text asks
    for. A text of one sign is not cut.
    """
    size = tokens if tokens is not None else F.floor(F.length("text") / 4) + 1
    whole = (size <= most) | (F.length("text") < 2)
    rows, done = documents.select("doc_id", F.lit("").alias("path"), "text"), None
    while True:
        short = rows.where(F.coalesce(whole, F.lit(True)))
        done = short if done is None else done.unionAll(short)
        rows = rows.where(~whole)
        if rows.isEmpty():
            break
        mid = F.ceil(F.length("text") / 2).cast("int")
        blank = F.locate(" ", F.substr("text", mid))
        cut = F.when((blank > 0) & (mid + blank - 1 < F.length("text")), mid + blank - 1).otherwise(mid)
        parts = F.array(F.struct(F.concat("path", F.lit("0")).alias("path"), F.trim(F.substr("text", F.lit(1), cut)).alias("text")), F.struct(F.concat("path", F.lit("1")).alias("path"), F.trim(F.substr("text", cut + 1)).alias("text")))
        rows = durable(rows.select("doc_id", F.explode(parts).alias("s")).select("doc_id", "s.path", "s.text"))
    return done.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("piece"), "text")


def filled_pages(pages: DataFrame, most: int) -> DataFrame:
    """doc_id, piece, first_page, last_page, n_tokens: pages in order fill pieces; a page that would take a piece over `most` tokens begins the next."""
    cut = greedy(pages, ["doc_id"], ["page"], F.col("tokens"), most)
    return cut.groupBy("doc_id", "piece").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("tokens").alias("n_tokens"))


def with_overlap(chunks: DataFrame, share: float = 0.1) -> DataFrame:
    """doc_id, idx, text: every chunk followed by the beginning of the next, `share` of its characters cut back to a whole word."""
    nxt = F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    head = F.regexp_extract(F.substr(nxt, F.lit(1), F.floor(F.length(nxt) * share).cast("int")), r"^(.*)\s", 1)
    return chunks.select("doc_id", "idx", F.when(head != "", F.concat("text", F.lit(" "), head)).otherwise(F.col("text")).alias("text"))


def batches(rows: DataFrame, group: str, order: str, tokens: str, most: int, count: int) -> DataFrame:
    """Adds `batch`: rows of a group in order, a new batch where `most` tokens would be reached or `count` rows are full."""
    cut = greedy(rows, [group], [order], F.col(tokens), most - 1, count)
    return cut.select(*rows.columns, F.col("piece").alias("batch"))


def section_batches(sentences: DataFrame, size: int = 15) -> DataFrame:
    """sid, doc_id, run, batch: neighbours of one section are a run, cut in batches of `size`."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    new = F.coalesce((F.col("section_id") != F.lag("section_id").over(w)).cast("int"), F.lit(1))
    rows = sentences.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("idx"))
    return rows.select("sid", "doc_id", "run", F.floor((number - 1) / size).alias("batch"))


def best_boxes(sentences: DataFrame, boxes: DataFrame, prefix: int = 40, least: int = 20) -> DataFrame:
    """doc_id, sid, box_id: the box (doc_id, box_id, text) that fits a sentence best.

    A box that holds the sentence's first `prefix` signs, or is held by the sentence with at least `least` signs; the
    longest common text wins, ties by box_id. Both meet on their document and first three words, so no task sees all pairs.
    """
    key = lambda c: F.array_join(F.slice(words(F.lower(F.col(c))), 1, 3), " ")
    s = sentences.select("doc_id", "sid", F.lower("text").alias("s"), key("text").alias("k"))
    b = boxes.select("doc_id", "box_id", F.lower("text").alias("b"), key("text").alias("k"))
    head = F.substring("s", 1, prefix)
    inside = F.col("s").startswith(F.col("b")) & (F.length("b") >= least)
    score = F.when(F.col("b").startswith(head), F.length(head)).when(inside, F.length("b"))
    met = s.join(b, ["doc_id", "k"]).withColumn("score", score).where(F.col("score").isNotNull())
    best = met.groupBy("doc_id", "sid").agg(F.max(F.struct("score", (-F.col("box_id")).alias("n"))).alias("m"))
    return best.select("doc_id", "sid", (-F.col("m.n")).alias("box_id"))


def by_section_title(chunks: DataFrame, pattern: str, per_document: int) -> DataFrame:
    """doc_id, idx of the first chunks of each document whose section title fits."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return chunks.where(F.col("title").rlike(pattern)).withColumn("r", rank).where(F.col("r") <= per_document).select("doc_id", "idx")


def summary_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(T.is_summary_title(F.col("title")))
