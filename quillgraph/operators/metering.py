"""Usage facts: calendar counters, quotas, sliding limits, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_counters(events: DataFrame) -> DataFrame:
    """user_id, period (day or month), bucket and n."""
    both = F.explode(F.array(F.struct(F.lit("day").alias("period"), F.date_format("ts", "yyyy-MM-dd").alias("bucket")), F.struct(F.lit("month").alias("period"), F.date_format("ts", "yyyy-MM").alias("bucket"))))
    return events.select("user_id", both.alias("b")).groupBy("user_id", "b.period", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


def quota(events: DataFrame, daily: int) -> DataFrame:
    """user_id, bucket, used, allowed: days on which a user stays within the daily limit, and what is left."""
    day = calendar_counters(events).where("period = 'day'")
    return day.select("user_id", "bucket", F.col("n").alias("used"), (F.col("n") <= daily).alias("allowed"), F.greatest(daily - F.col("n"), F.lit(0).cast("long")).alias("remaining"))


def sliding_count(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """event_id, recent, limited: events of the user in the last `seconds` up to and including each event."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = events.withColumn("recent", F.count(F.lit(1)).over(w))
    return out.select("event_id", "recent", (F.col("recent") > limit).alias("limited"))


def credits_by_month(events: DataFrame, credits) -> DataFrame:
    return events.select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), credits.alias("c")).groupBy("user_id", "month").agg(F.sum("c").alias("credits"))


def user_activity(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of users by events: user_id, n, total value, last ts."""
    per = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))
    return per.orderBy(F.desc("n"), "user_id").offset(offset).limit(limit)


def hour_buckets(events: DataFrame, latest: int = 24) -> DataFrame:
    """bucket, n of the latest hours with events."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bucket")).limit(latest)


def system_metrics(events: DataFrame) -> DataFrame:
    """One row: events, users and types, and the events of the last day with any."""
    last = events.agg(F.max(F.to_date("ts")).alias("day"))
    return (
        events.crossJoin(F.broadcast(last))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.countDistinct("user_id").alias("users"),
            F.countDistinct("event_type").alias("types"),
            F.count_if(F.to_date("ts") == F.col("day")).alias("last_day"),
            F.count_if(F.date_trunc("month", "ts") == F.date_trunc("month", "day")).alias("last_month"),
        )
    )


def stale_jobs(events: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """user_id, started: start events that no end event of the user follows within `seconds`."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.where(F.col("event_type").isin(start, end)).withColumn("next", F.lead("event_type").over(w)).withColumn("at", F.lead("ts").over(w))
    open_ = F.col("at").isNull() | (F.col("next") != end) | (F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > seconds)
    return rows.where((F.col("event_type") == start) & open_).select("event_id", "user_id")
