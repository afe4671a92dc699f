"""Sources: every format becomes (path, page, offset, content) rows, read in parallel by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Hosts that no fetch may reach.
PRIVATE_HOST = r"^(localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|169\.254\..*|0\.0\.0\.0|\[?::1\]?)(:\d+)?$"


def clean(c: Column) -> Column:
    """Runs of line ends, blanks and dashes become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\n{2,}", "\n"), r"[^\S\n]{2,}", " "), r"-{2,}", "--"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("page"), F.lit(0).cast("long").alias("offset"), clean(F.col("value")).alias("content"))


def csv_files(spark: SparkSession, path: str, columns: int = 64) -> DataFrame:
    """One page a row after the header, values joined by commas; quoted values may hold commas and line ends.

    Pages count from 0 and offsets are those of the content before, in the order of rows of a file. Rows of fewer
    than `columns` values are padded by the reader and cut again here; of a row with more, the whole record is taken
    apart here, so none is lost.
    """
    names = [f"c{i}" for i in range(columns)]
    schema = ", ".join(f"{n} string" for n in [*names, "_record"])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, escape='"', recursiveFileLookup=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, columnNameOfCorruptRecord="_record", mode="PERMISSIVE")
    values = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace("_record", r"\r?\n$", "")), F.lit(r',\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = F.transform(values, lambda v: F.when(v.startswith('"'), F.replace(F.regexp_replace(v, r'(?s)^"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"'))).otherwise(F.trim(v)))
    wide = F.coalesce(F.length("_record") - F.length(F.replace("_record", F.lit(","))) >= columns, F.lit(False))
    line = F.when(wide & (F.size(values) > columns), F.array_join(F.filter(bare, lambda v: v != ""), ",")).otherwise(F.concat_ws(",", *names))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), line.alias("content")).where("content <> ''")
    w = Window.partitionBy("path").orderBy("at")
    run = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("path", (F.row_number().over(w) - 1).alias("page"), run.alias("offset"), "content")


def json_pages(df: DataFrame, column: str) -> DataFrame:
    """page, content of a JSON text column: an array gives a page an element, an object one page."""
    body = F.col(column)
    items = F.when(F.trim(body).startswith("["), F.from_json(body, "array<variant>")).otherwise(F.array(F.try_parse_json(body)))
    return df.select("*", F.posexplode(items).alias("page", "__v")).withColumn("content", F.to_json("__v")).drop("__v")


def html_pages(df: DataFrame, column: str = "html") -> DataFrame:
    """title, content of an HTML column: scripts, styles and tags dropped, the five basic references decoded."""
    body = F.col(column)
    out = F.regexp_replace(body, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return df.withColumns({"title": F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)), "content": F.trim(F.regexp_replace(out, r"\s+", " "))})


def safe_url(url: Column) -> Column:
    """False for urls without an http host, or with one inside a private network."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?([^/?#]*)", 1))
    return F.coalesce((host != "") & ~F.regexp_like(host, F.lit(PRIVATE_HOST)), F.lit(False))


def changed_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of (path, content) whose MD5 is not the one known for the path."""
    now = current.withColumn("md5", F.md5("content"))
    return now.join(known.select("path", "md5"), ["path", "md5"], "left_anti")
