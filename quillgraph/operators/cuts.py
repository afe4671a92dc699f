"""Greedy cuts of ordered rows, without one task a group.

A greedy cut is a loop: a row that would take its piece over the limit begins
the next one. Here every row gets a pointer to where the next piece would begin
if one began at it, found by a range search on running sums; jumps along the
pointers, twice as far each round, then reach all beginnings that the loop
would find. Running sums are taken over ranges of the order, and the search
over stretches of a sum as wide as the limit, so that a group may be of any
length. Rounds are as many as the logarithm of the most pieces of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import durable


def ranged(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with __g (the group as one value, which null equals null in), dealt to ranges of the order, numbered by __part; written out, so that both stay."""
    keyed = rows.withColumn("__g", F.struct(*[F.col(c) for c in group]))
    return durable(keyed.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))


def running(rows: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """Adds for each of `values` its sum over the rows of the group before this one; `rows` come from `ranged`. Nulls count as 0."""
    given = rows.withColumns({f"__v_{name}": F.coalesce(v, F.lit(0)) for name, v in values.items()})
    own = Window.partitionBy("__g", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = given.groupBy("__g", "__part").agg(*[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in values])
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__g", "__part", *[F.coalesce(F.sum(f"__s_{name}").over(earlier), F.lit(0)).alias(f"__s_{name}") for name in values])
    inner = given.withColumns({name: F.coalesce(F.sum(f"__v_{name}").over(own), F.lit(0)) for name in values})
    out = inner.join(parts, ["__g", "__part"])
    return out.withColumns({name: F.col(name) + F.col(f"__s_{name}") for name in values}).drop(*[f"__{k}_{name}" for k in "vs" for name in values])


def _pointers(rows: DataFrame, most: int, count: int | None, overlap: int) -> DataFrame:
    """__g, n, flag, to, to_flag: where the next piece begins if one begins at row n; flag 1: the piece repeats `overlap` of the one before."""
    width = most + 1
    starts = rows
    if count is None:  # a row of no size begins a piece only as the first row, or after one that is over the limit by itself
        after = rows.where(F.col("size") > most - overlap).select("__g", (F.col("n") + 1).alias("n"))
        starts = rows.where("size > 0 or n = 0").unionAll(rows.where("size = 0 and n > 0").join(after, ["__g", "n"], "left_semi").select(*rows.columns))
    flags = F.explode(F.array(F.lit(0), F.lit(1))) if overlap else F.lit(0)
    asks = starts.select("__g", "n", "before", flags.alias("flag")).withColumn("pos", F.col("before") + most - F.col("flag") * overlap)
    # a row stands for the stretch [before, before + size) of the running sum, in every cell that it touches
    first, last = F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("size") - 1) / width)
    stretch = F.struct(F.col("n").alias("at"), (F.col("before") + F.col("size")).alias("end"), F.col("before").alias("begin"))
    spans = rows.where("size > 0").select("__g", F.explode(F.sequence(first, last)).alias("cell"), F.col("before").alias("pos"), F.lit(0).alias("kind"), stretch.alias("row"))
    both = spans.unionByName(asks.select("__g", F.floor(F.col("pos") / width).alias("cell"), "pos", F.lit(1).alias("kind"), "n", "flag", "before"), allowMissingColumns=True)
    seen = F.last("row", ignorenulls=True).over(Window.partitionBy("__g", "cell").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("row", seen).where("kind = 1").withColumn("to", F.when(F.col("row.end") > F.col("pos"), F.greatest(F.col("row.at"), F.col("n") + 1)))
    if count is not None:
        found = found.withColumn("to", F.least("to", F.col("n") + count))
    out = found.where("to is not null").select("__g", "n", "flag", "to", "before")
    total = rows.select("__g", F.col("n").alias("to"), F.col("before").alias("upto"))  # also drops what lies beyond the last row
    out = out.join(total, ["__g", "to"])
    repeats = (F.col("flag") * overlap + F.col("upto") - F.col("before") > overlap).cast("int") if overlap else F.lit(0)
    return out.select("__g", "n", "flag", "to", repeats.alias("to_flag"))


def greedy(rows: DataFrame, group: list[str], order: list[str], size: Column, most: int, count: int | None = None, overlap: int = 0) -> DataFrame:
    """`rows` and piece, piece_start, repeats and place (number in the group): rows of a group in order, a new piece where the sizes would pass `most` in sum or `count` rows are full.

    A piece has one row at least, whatever its size. With `overlap` a piece but
    the first is taken to begin with so much of the one before, if that is
    larger than it (`repeats`). Sizes are whole numbers from 0, null counts as
    0. `order` tells all rows of a group apart; rows that it does not may swap.
    """
    whole = F.greatest(F.coalesce(size.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    laid = ranged(rows.withColumn("size__", whole), group, order)
    laid = durable(running(laid, order, __n=F.lit(1).cast("long"), __before=F.col("size__")))
    plain = laid.select("__g", F.col("__n").alias("n"), F.col("__before").alias("before"), F.col("size__").alias("size"))
    jump = durable(_pointers(plain, most, count, overlap))
    marks = durable(plain.where("n = 0").select("__g", "n", F.lit(0).alias("flag"), F.lit(0).cast("long").alias("step")))
    far = 1
    while True:
        ahead = durable(marks.join(jump, ["__g", "n", "flag"]).select("__g", F.col("to").alias("n"), F.col("to_flag").alias("flag"), (F.col("step") + far).alias("step")))
        if ahead.isEmpty():
            break
        marks = marks.unionByName(ahead)
        onward = jump.select("__g", F.col("n").alias("to"), F.col("flag").alias("to_flag"), F.col("to").alias("__to"), F.col("to_flag").alias("__flag"))
        jump = durable(jump.join(onward, ["__g", "to", "to_flag"]).select("__g", "n", "flag", F.col("__to").alias("to"), F.col("__flag").alias("to_flag")))
        far *= 2
    begins = marks.select("__g", F.col("n").alias("__n"), F.col("flag").alias("__flag"), F.lit(1).cast("long").alias("__begins"))
    flagged = laid.join(begins, ["__g", "__n"], "left")
    out = running(flagged, ["__n"], __piece=F.col("__begins"))
    piece = F.col("__piece") + F.coalesce("__begins", F.lit(0).cast("long")) - 1
    names = [F.col(c) for c in rows.columns]
    return out.select(*names, piece.alias("piece"), F.col("__begins").isNotNull().alias("piece_start"), (F.coalesce("__flag", F.lit(0)) == 1).alias("repeats"), F.col("__n").alias("place"))
