"""Global row numbers without a global sort or a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lanes that rows are dealt to. A fixed number: the numbering must not depend on the cluster.
LANES = 4096


def numbered(df: DataFrame, order: list[Column], out: str, within: list[str] | None = None, lanes: int = LANES) -> DataFrame:
    """Adds `out`: gapless numbers from 0, over all rows or over each combination of `within`.

    Rows go to lanes by a hash of `order`; a number is the rows in earlier
    lanes plus the rank in the own lane.  Lane sizes are one small row per
    lane (and group), so the offsets are a bounded table whatever the input.
    Rows that agree in all of `order` are interchangeable and may swap numbers.
    """
    within = within or []
    keys = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order, strict=True)))
    rows = rows.withColumn("__lane", F.pmod(F.xxhash64(*keys), F.lit(lanes)).cast("int"))
    rank = F.row_number().over(Window.partitionBy(*within, "__lane").orderBy(*keys)) - 1
    earlier = F.sum("__size").over(Window.partitionBy(*within).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__w{i}" for i in range(len(within))]
    starts = (
        rows.groupBy(*within, "__lane")
        .agg(F.count(F.lit(1)).alias("__size"))
        .select(*[F.col(c).alias(n) for c, n in zip(within, names, strict=True)], F.col("__lane").alias("__l"), F.coalesce(earlier, F.lit(0)).alias("__start"))
    )
    on = F.col("__lane") == F.col("__l")
    for c, n in zip(within, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return rows.withColumn("__rank", rank).join(F.broadcast(starts), on).withColumn(out, (F.col("__start") + F.col("__rank")).cast("long")).drop("__lane", "__rank", "__l", "__start", *keys, *names)
