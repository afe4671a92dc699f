"""Layout results to rows: sections, tables, barcodes, marks, signature blocks and the boxes of sentences.

The layout itself comes from outside and lands as rows; `paragraphs` is the
stand-in for plain text. Everything else is windows, range joins and
aggregations over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import overlapping

# What a signature line says, and how many lines around it belong to its block.
SIGNATURE_ANCHOR = r"(?i)\b(signed by|signature|authorized|date:|title:|by:)"
AROUND = 2


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, idx, role, content of the lines of each text: a short line without a full stop at its end is a heading."""
    lines = F.filter(F.transform(F.split("text", r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    heading = (F.length("content") <= 60) & ~F.col("content").rlike(r"[.!?;:,]$")
    return documents.select("doc_id", F.posexplode(lines).alias("idx", "content")).select("doc_id", "idx", F.when(heading, "sectionHeading").otherwise("paragraph").alias("role"), "content")


def with_section(rows: DataFrame) -> DataFrame:
    """Adds `section`, the number of headings so far in the document (0 before the first), and `heading`, the running one."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("role") == "sectionHeading", F.col("content"))
    return rows.withColumns({"section": F.sum((F.col("role") == "sectionHeading").cast("int")).over(w), "heading": F.last(title, ignorenulls=True).over(w)})


def section_units(rows: DataFrame) -> DataFrame:
    """doc_id, section, heading, n, content: one unit for each section, its paragraphs joined by line ends."""
    body = F.sort_array(F.collect_list(F.when(F.col("role") != "sectionHeading", F.struct("idx", "content"))))
    return with_section(rows).groupBy("doc_id", "section").agg(F.max("heading").alias("heading"), F.count(F.lit(1)).alias("n"), F.array_join(body["content"], "\n").alias("content"))


def chunk_rules(units: DataFrame, least: int, most: int, overlap: int) -> DataFrame:
    """doc_id, first_section, piece, n_words, content: units below `least` words join the unit before them, then texts over `most` words are cut with `overlap` words in common."""
    words = F.filter(F.split("content", r"\s+"), lambda x: x != "")
    w = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("w", words).withColumn("g", F.sum((F.size("w") >= least).cast("int")).over(w))
    joined = rows.groupBy("doc_id", "g").agg(F.min("section").alias("first_section"), F.flatten(F.sort_array(F.collect_list(F.struct("section", "w")))["w"]).alias("w")).where(F.size("w") > 0)
    step = most - overlap
    last = F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0))
    cut = joined.select("doc_id", "first_section", "w", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    own = F.slice("w", F.col("piece") * step + 1, most)
    return cut.select("doc_id", "first_section", "piece", F.size(own).alias("n_words"), F.array_join(own, " ").alias("content"))


def tables(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, headers, rows, n_rows from cells (doc_id, table_id, row, col, text): row 0 is the header, every other row an array in order of columns."""
    line = cells.groupBy("doc_id", "table_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text")))["text"].alias("cells"))
    body = F.sort_array(F.collect_list(F.when(F.col("row") > 0, F.struct("row", "cells"))))["cells"]
    return line.groupBy("doc_id", "table_id").agg(F.max(F.when(F.col("row") == 0, F.col("cells"))).alias("headers"), body.alias("rows")).withColumn("n_rows", F.size("rows"))


def barcode_type(kind: Column, value: Column) -> Column:
    """What a barcode stands for, by its kind and value."""
    k = F.lower(kind)
    parcel = (value.startswith("1Z") & (F.length(value) == 18)) | value.rlike(r"^\d{12,34}$")
    return (
        F.when(k.contains("upc") | k.contains("ean"), "PRODUCT_CODE")
        .when(k.contains("qr"), F.when(value.rlike("^https?://"), "URL").otherwise("QR_DATA"))
        .when((k.contains("code128") | k.contains("code39")) & parcel, "TRACKING_NUMBER")
        .when(k.contains("pdf417"), "DOCUMENT_ID")
        .otherwise("BARCODE")
    )


def barcodes(documents: DataFrame) -> DataFrame:
    """doc_id, kind, value, entity_type of every element of `barcodes` (array of kind, value) that has a value."""
    return documents.select("doc_id", F.explode("barcodes").alias("b")).where("b.value <> ''").select("doc_id", "b.kind", "b.value", barcode_type(F.col("b.kind"), F.col("b.value")).alias("entity_type"))


def selection_marks(documents: DataFrame) -> DataFrame:
    """doc_id, selected, unselected: how many boxes of `marks` (array of state) are ticked."""
    return documents.select("doc_id", F.explode("marks").alias("s")).groupBy("doc_id").agg(F.count_if(F.col("s") == "selected").alias("selected"), F.count_if(F.col("s") == "unselected").alias("unselected"))


def figures(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, figure_id, caption, sections: figures (id, caption, elements) and the sections that their elements (paragraph numbers) stand in."""
    f = documents.select("doc_id", F.explode("figures").alias("f")).select("doc_id", "f.id", "f.caption", F.explode_outer("f.elements").alias("idx"))
    met = f.join(with_section(rows).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "section"), ["doc_id", "idx"], "left")
    return met.groupBy("doc_id", F.col("id").alias("figure_id"), "caption").agg(F.sort_array(F.collect_set("section")).alias("sections"))


def signature_blocks(rows: DataFrame, around: int = AROUND) -> DataFrame:
    """doc_id, block, first, last, lines: paragraphs within `around` of a line with a signature anchor; runs of them are one block."""
    near = F.max(F.col("content").rlike(SIGNATURE_ANCHOR).cast("int")).over(Window.partitionBy("doc_id").orderBy("idx").rangeBetween(-around, around))
    hit = rows.withColumn("near", near).where("near = 1")
    gap = (F.col("idx") - F.lag("idx", 1, -10).over(Window.partitionBy("doc_id").orderBy("idx")) > 1).cast("int")
    island = F.sum("gap").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return hit.withColumn("gap", gap).withColumn("block", island).groupBy("doc_id", "block").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("lines"))


def sentence_boxes(sentences: DataFrame, words: DataFrame, gap: float = 0.015) -> DataFrame:
    """doc_id, sentence_id, line, x0, y0, x1, y1: one box for each line of a sentence.

    Words (doc_id, id, start, end, x0, y0, x1, y1) that overlap a sentence's span (doc_id, id, start, end) are its
    own; a word that begins more than `gap` below the one before it begins a line.
    """
    own = overlapping(sentences, words).select("doc_id", F.col("a_id").alias("sentence_id"), F.col("b_id").alias("id")).join(words, ["doc_id", "id"])
    w = Window.partitionBy("doc_id", "sentence_id").orderBy("start", "id")
    new = (F.col("y0") - F.lag("y0").over(w) > gap).cast("int")
    lines = own.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return box(lines, ["doc_id", "sentence_id", "line"])


def box(rows: DataFrame, by: list[str]) -> DataFrame:
    """The bounding box of each group."""
    return rows.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def page_of(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """sentence_id, page: the page of the paragraph span (doc_id, id, start, end, page) in which a sentence begins; spans do not overlap."""
    at = sentences.select("doc_id", "id", "start", (F.col("start") + 1).alias("end"))
    return overlapping(at, spans).select("doc_id", F.col("a_id").alias("sentence_id"), F.col("b_id").alias("id")).join(spans.select("doc_id", "id", "page"), ["doc_id", "id"]).select("doc_id", "sentence_id", "page")


def letterhead(rows: DataFrame, most: int = 5, words: int = 50) -> DataFrame:
    """doc_id, idx of the leading paragraphs of a document up to the first heading or long line: at most `most`, and `words` words together."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    stop = (F.col("role") == "sectionHeading") | (F.length("content") > 200)
    marked = rows.withColumns({"stopped": F.max(stop.cast("int")).over(w), "n": F.count(F.lit(1)).over(w), "words": F.sum(F.size(F.split(F.trim("content"), r"\s+"))).over(w)})
    return marked.where((F.col("stopped") == 0) & (F.col("n") <= most) & (F.col("words") <= words)).select("doc_id", "idx")


def signature_sentence(lines: Column) -> Column:
    """The lines of a signature block as one sentence: blank fillers and bare labels are left out."""
    good = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.rlike(r"^[_\-. ]*$") & ~x.rlike(r"^[A-Za-z ]{1,20}:$"))
    return F.array_join(good, ". ")
