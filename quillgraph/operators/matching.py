"""Matchings: edges under a limit for each node, and headers of tables to fields of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import durable


def nearest_edges(pairs: DataFrame, most: int) -> DataFrame:
    """a < b, score: pairs that are among the `most` best of one of their ends (ties by the other end's id)."""
    ends = pairs.select("a", "b", "score")
    both = ends.select(F.col("a").alias("own"), F.col("b").alias("other"), "score").unionAll(ends.select(F.col("b").alias("own"), F.col("a").alias("other"), "score"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "other"))).where(F.col("r") <= most)
    return best.groupBy(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.max("score").alias("score"))


def b_matching(edges: DataFrame, most: int) -> DataFrame:
    """a < b, score: what a greedy loop keeps that goes through the edges by falling score (ties by a, then b) and takes each one whose ends both have fewer than `most` yet.

    In a round all edges are taken that are, at both ends, among as many of the best that are left as the end has room
    for: whatever the loop does with those before them, it takes these. Edges of full ends then go. The best edge left
    is always taken, so rounds end; each is written out. Loops and rows with a null are ignored, of repeated edges the
    best score counts.
    """
    pair = edges.where("a <> b and score is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    left, out = durable(pair.select("a", "b", "score", F.lit(most).alias("room_a"), F.lit(most).alias("room_b"))), None
    while True:
        at = lambda end: left.select("a", "b", "score", F.col(end).alias("own"), F.col(f"room_{end}").alias("room"))  # noqa: E731, B023
        rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "a", "b"))
        good = at("a").unionAll(at("b")).withColumn("r", rank).where("r <= room").groupBy("a", "b").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
        taken = durable(good.where("n = 2").select("a", "b", "score"))
        out = taken if out is None else out.unionAll(taken)
        used = taken.select(F.col("a").alias("own")).unionAll(taken.select("b")).groupBy("own").agg(F.count(F.lit(1)).alias("u"))
        rest = left.join(taken.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(used.select(F.col("own").alias(end), F.col("u").alias(f"used_{end}")), end, "left").withColumn(f"room_{end}", F.col(f"room_{end}") - F.coalesce(f"used_{end}", F.lit(0))).where(F.col(f"room_{end}") > 0)
        left = durable(rest.select("a", "b", "score", "room_a", "room_b"))
        if left.isEmpty():
            return out


def likeness(a: Column, b: Column) -> Column:
    """Millionths by which two texts agree: 1 less their edit distance over the longer one's length; two empty texts agree."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1_000_000)).otherwise(F.floor((longer - F.levenshtein(a, b)) * 1_000_000 / longer)).cast("long")


def header_options(headers: DataFrame, names: DataFrame, least: int = 600_000) -> DataFrame:
    """table_id, header, field, score: fields that a header may stand for, from headers (table_id, header) and a schema's names (field, name).

    Both are compared without case and outer blanks, by edit distance; a field with several names has the best of them.
    """
    plain = lambda c: F.lower(F.trim(F.col(c)))
    known = headers.select(plain("header").alias("h")).where("h is not null").distinct()
    score = likeness(F.col("h"), F.col("n"))
    schema = F.broadcast(names.select("field", plain("name").alias("n")).distinct())  # a schema: it does not grow with the tables
    near = known.join(schema, F.levenshtein("h", "n") <= F.greatest(F.length("h"), F.length("n"))).withColumn("score", score).where(F.col("score") >= least)
    best = near.groupBy("h", "field").agg(F.max("score").alias("score"))
    return headers.select("table_id", "header", plain("header").alias("h")).distinct().join(best, "h").select("table_id", "header", "field", "score")


def assigned(options: DataFrame) -> DataFrame:
    """table_id, header, field, score: for each table the one-to-one choice of headers and fields with the greatest sum of scores.

    Of equal sums, the one in which the first header (by name) has the first field (by name), and no field last; and so
    on. Headers are taken one after another for all tables at once: a state is the set of fields that are used, and of
    the ways to one state the best is kept, so a table costs its headers times the sets that its options allow.
    A table has at most 62 fields among its options.
    """
    own = lambda c: F.dense_rank().over(Window.partitionBy("table_id").orderBy(c))
    rows = durable(options.groupBy("table_id", "header", "field").agg(F.max("score").alias("score")).withColumns({"h": own("header"), "f": own("field")}))
    last = rows.agg(F.max("h")).first()[0] or 0
    state = rows.select("table_id").distinct().select("table_id", F.lit(0).cast("long").alias("used"), F.struct(F.lit(0).cast("long").alias("less"), F.array().cast("array<int>").alias("path")).alias("best"))
    for h in range(1, last + 1):
        here = rows.where(F.col("h") == h).select("table_id", "f", "score")
        with_h = here.select("table_id").distinct().withColumn("any", F.lit(True))
        grown = lambda f: F.concat("best.path", F.array(f.cast("int")))
        passed = state.join(with_h, "table_id", "left").select("table_id", "used", F.struct(F.col("best.less").alias("less"), F.when(F.col("any"), grown(F.lit(99))).otherwise(grown(F.lit(0))).alias("path")).alias("best"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("f"))
        taken = state.join(here, "table_id").where(F.col("used").bitwiseAND(bit) == 0).select("table_id", F.col("used").bitwiseOR(bit).alias("used"), F.struct((F.col("best.less") - F.col("score")).alias("less"), grown(F.col("f")).alias("path")).alias("best"))
        state = durable(passed.unionAll(taken).groupBy("table_id", "used").agg(F.min("best").alias("best")))
    best = state.groupBy("table_id").agg(F.min("best")["path"].alias("path")).select("table_id", F.posexplode("path").alias("at", "f")).select("table_id", (F.col("at") + 1).alias("h"), "f")
    return rows.join(best, ["table_id", "h", "f"]).select("table_id", "header", "field", "score")


def table_facts(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """row, value, field, header: the value nodes of tables' rows and what ties them to the row, from cells (table_id, row_id, header, value) and assigned headers; empty values have none."""
    rows = cells.where("value is not null and value <> ''").join(mapping.select("table_id", "header", "field"), ["table_id", "header"])
    return rows.select(F.concat_ws("_", F.lit("Row"), "table_id", "row_id").alias("row"), "value", "field", "header")
