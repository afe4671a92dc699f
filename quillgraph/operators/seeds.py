"""Seeds for graph walks: where they come from, what they weigh, and how tightly the walk stays around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def damping(entity_weight: float) -> float:
    """0.70 + 0.20 w: the more weight named entities have, the closer the walk stays to them."""
    return round(0.70 + 0.20 * entity_weight, 4)


def scaled(rows: DataFrame, column: str = "score") -> DataFrame:
    """Scores as 0 to 1 between the least and the greatest; one score alone is 1."""
    low = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return rows.crossJoin(F.broadcast(low)).withColumn(column, F.when(span > 0, (F.col(column) - F.col("__lo")) / span).otherwise(1.0)).drop("__lo", "__hi")  # one row


def tiers(sources: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """node, weight, tiers: each tier's weight is shared among its distinct nodes; a node sums what its tiers give it."""
    parts = []
    for name, (rows, weight) in sources.items():
        own = rows.select("node").distinct()
        count = own.agg(F.count(F.lit(1)).alias("n"))
        parts.append(own.crossJoin(F.broadcast(count)).select("node", (F.lit(weight) / F.col("n")).alias("weight"), F.lit(name).alias("tier")))  # one row
    return reduce(DataFrame.unionAll, parts).groupBy("node").agg(F.round(F.sum("weight"), 9).alias("weight"), F.array_join(F.sort_array(F.collect_set("tier")), ",").alias("tiers"))


def flat_pool(sources: dict[str, DataFrame]) -> DataFrame:
    """node, sources, n: the union of all sources' nodes with equal weight, and which of them name each."""
    rows = reduce(DataFrame.unionAll, [df.select("node", F.lit(name).alias("source")).distinct() for name, df in sources.items()])
    return rows.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


def pool_stats(pool: DataFrame) -> DataFrame:
    """sources, nodes: how many nodes each combination of sources names: alone, or together."""
    return pool.groupBy("sources").agg(F.count(F.lit(1)).alias("nodes"))


def from_facts(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """node, weight: entities of ranked facts (src, dst, score): the scaled score over the number of the entity's sentences, as the mean over its facts."""
    count = mentions.groupBy(F.col("eid").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    ends = scaled(facts).select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "score")
    rows = ends.join(count, "node", "left").select("node", (F.col("score") / F.coalesce("n", F.lit(1))).alias("w"))
    return rows.groupBy("node").agg(F.round(F.avg("w"), 9).alias("weight"))


def from_passages(hits: DataFrame, share: float = 0.05) -> DataFrame:
    """node, weight: passages (node, score) with `share` of their scaled score."""
    return scaled(hits).select("node", F.round(F.col("score") * share, 9).alias("weight"))


def strongest(*parts: DataFrame) -> DataFrame:
    """node, weight: the greatest weight that any part gives a node."""
    return reduce(DataFrame.unionAll, [p.select("node", "weight") for p in parts]).groupBy("node").agg(F.max("weight").alias("weight"))
