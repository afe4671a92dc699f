"""Streams give what the batch operators give, for all events that the watermark has passed."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillgraph.operators import metering
from quillgraph.streaming import usage


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The events in files by time, three rows of one time among them, and the first file once more at the end."""
    folder = str(tmp_path_factory.mktemp("stream") / "events")
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ties = events.orderBy("ts", "event_id").limit(3).withColumns({"user_id": F.lit(7).cast("long"), "ts": F.lit("2024-01-05 10:00:00").cast("timestamp"), "event_id": F.col("event_id") + 10_000_000})
    events = events.unionByName(ties)
    for i, (low, high) in enumerate((("2023-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2025-01-01"))):
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def test_sliding_limit(spark, source, tmp_path):
    got = {(r["event_id"], r["recent"], r["limited"]) for r in run(usage.limited(usage.timed(usage.read_events(spark, source), "1 hour"), 3600, 2), "limited", tmp_path / "cp").collect()}
    events = spark.read.parquet(source)
    mark = events.agg(F.max("ts")).first()[0]
    passed = events.where(F.col("ts") <= F.lit(mark) - F.expr("interval 1 hour")).select("event_id")
    want = {(r["event_id"], r["recent"], r["limited"]) for r in metering.sliding_count(events, 3600, 2).join(passed, "event_id").collect()}
    assert got == want and len(got) > 900


def test_hourly(spark, source, tmp_path):
    events = spark.read.parquet(source)
    twice = str(tmp_path / "twice")  # every event is delivered two times in its file
    for day in ("2024-01-10", "2024-01-20", "2025-01-01"):
        part = events.where(F.col("ts") < day)
        part.unionByName(part).coalesce(1).write.mode("append").parquet(twice)
        events = events.where(F.col("ts") >= day)
    events = spark.read.parquet(source)
    got = {(r["user_id"], r["bucket"], r["n"], round(r["total"], 6)) for r in run(usage.hourly(usage.once(usage.timed(usage.read_events(spark, twice)))), "hourly", tmp_path / "cp").collect()}
    end = F.col("w.end") <= F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("interval 2 hours")
    rows = events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).where(end)
    want = {(r["user_id"], r["w"]["start"], r["n"], round(r["total"], 6)) for r in rows.collect()}
    assert got == want and len(got) > 500
