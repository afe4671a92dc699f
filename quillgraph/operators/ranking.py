"""Top-k per group, coverage, diversity and fusion of ranked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import durable


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group. Ranks within a limit are cut before the shuffle by Spark's group-limit rule."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def numbered(df: DataFrame, order: list[Column], group: str | None = None, name: str = "rank") -> DataFrame:
    """All rows with their place from 1 in `order`, which must tell all rows apart, in each value of `group` (null is one) or in the whole table.

    No group lies in one task: the sort deals ranges of rows to tasks, each row
    is numbered inside its range, and what stands before a range is added. The
    sorted rows are written as a table, so that a lost executor can't deal them
    differently. Sizes of ranges, one a task, and first places are joined.
    """
    keys = [F.col(group)] if group else []
    place = {"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    rows = durable(df.orderBy(*keys, *order).withColumns(place))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each task of the sort
    out = rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
    if not group:
        return out
    first = out.groupBy(F.col(group).alias("__group")).agg(F.min(name).alias("__first"))
    return out.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__group", "__first")


def round_robin(df: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """At most `per_group` rows a group, dealt one group after another by key until `total`; `position` from 1."""
    own = top_per_group(df, [group], order, per_group)
    turn = own.orderBy("rank", group).limit(total)
    return turn.withColumn("position", F.row_number().over(Window.orderBy("rank", group))).drop("rank")


def two_caps(df: DataFrame, order: list[Column], caps: list[tuple[str, int]], limit: int) -> DataFrame:
    """Rows in order, at most n of each value of each capped column, at most `limit`.

    The caps hold one after another (by the first column, then by the second
    among those left), which keeps every step a partitioned window.
    """
    for column, most in caps:
        df = top_per_group(df, [column], order, most, "__r").drop("__r")
    return df.orderBy(*order).limit(limit)


def diversify(df: DataFrame, k: int, least: int = 2, gate: float = 0.85) -> DataFrame:
    """Top k of (id, doc_id, score): documents whose best score reaches gate * top keep `least` places each, the rest go by score."""
    w = Window.partitionBy("doc_id")
    top = df.agg(F.max("score").alias("top"))
    rows = df.withColumn("best", F.max("score").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "id"))).crossJoin(F.broadcast(top))
    reserved = (F.col("best") >= gate * F.col("top")) & (F.col("r") <= least)
    rows = rows.withColumn("reserved", reserved.cast("int")).orderBy(F.desc("reserved"), F.desc("score"), "id").limit(k)
    return rows.select("id", "doc_id", "score")


def near_best(df: DataFrame, share: float = 0.90) -> DataFrame:
    """Rows of documents whose best score is at least share * the best of all."""
    best = df.groupBy("doc_id").agg(F.max("score").alias("best"))
    top = best.agg(F.max("best").alias("top"))
    keep = best.crossJoin(F.broadcast(top)).where(F.col("best") >= share * F.col("top")).select("doc_id")
    return df.join(keep, "doc_id", "left_semi")


def gap_prune(df: DataFrame, after: int = 6, drop: float = 0.5) -> DataFrame:
    """Ranked rows (id, score) up to the first fall of more than `drop` of the score before, counted from rank `after` on.

    Rows go to ranges of the ranking; a range's ranks start after the counts of
    those before it, so that only one row a range meets in one place.
    """
    order = [F.desc("score"), F.asc("id")]
    rows = durable(df.select("id", "score").repartitionByRange(*order).withColumn("p", F.spark_partition_id()))
    n = F.count(F.lit(1))
    ends = rows.groupBy("p").agg(n.alias("n"), F.when(F.count("score") == n, F.min("score")).alias("last"))
    w = Window.orderBy("p")
    ends = ends.select("p", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"), F.lag("last").over(w).alias("before"))
    own = Window.partitionBy("p").orderBy(*order)
    place = F.row_number().over(own)
    rows = rows.join(F.broadcast(ends), "p").withColumn("r", place).withColumn("prev", F.when(F.col("r") == 1, F.col("before")).otherwise(F.lag("score").over(own))).withColumn("rank", F.col("base") + F.col("r"))
    cut = rows.where((F.col("rank") > after) & (F.col("score") < (1 - drop) * F.col("prev"))).agg(F.min("rank").alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col("rank") < F.col("cut"))).select("id", "score", "rank")


def rrf(*lists: DataFrame, k: int = 60) -> DataFrame:
    """id, score, hits: reciprocal rank fusion of lists (id, rank): the sum of 1 / (k + rank)."""
    both = reduce(DataFrame.unionAll, [x.select("id", "rank") for x in lists])
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.count(F.lit(1)).alias("hits"))


def weighted(*lists: tuple[DataFrame, float]) -> DataFrame:
    """id, score: weighted sum of scores scaled to 0..1 in each list (id, score); a list of one score scales to 1."""
    parts = []
    for df, weight in lists:
        ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        parts.append(df.crossJoin(F.broadcast(ends)).select("id", (scaled * weight).alias("score")))
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))


def within_budget(df: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order while their running cost stays within the budget."""
    run = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", run).where(F.col("running") <= budget)
