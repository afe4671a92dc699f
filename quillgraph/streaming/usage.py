"""Metering over streams: the same facts as the batch operators, with watermarks.

`timed` sets the watermark, once for a stream; the other functions take a
stream that has one, so that they can be put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """`events` with a watermark: rows that come later than `late` behind the newest may be dropped."""
    return events.withWatermark("ts", late)


def hourly(events: DataFrame) -> DataFrame:
    """user_id, bucket, n, total for each hour; an hour is final once the watermark has passed it (append mode)."""
    return events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("bucket"), "n", "total")


def once(events: DataFrame) -> DataFrame:
    """Events without repeats of their id inside the watermark: at-least-once delivery becomes once."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def limited(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """user_id, event_id, recent, limited: a sliding limit kept as state.

    Events wait until the watermark has passed them and are then counted in
    order of time, so late ones count in their place; events of one time count
    each other. A user's state is the events that wait and the times of the
    last `seconds`; it is removed when both are empty.
    """
    span = seconds * 1_000_000

    def update(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, waiting, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for page in pages:
                waiting += page["ts"].astype("datetime64[us]").astype("int64").tolist()
                ids += page["event_id"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(ids)), key=lambda i: (waiting[i], ids[i]))
        ready = [(waiting[i], ids[i]) for i in order if waiting[i] <= mark]
        times += [at for at, _ in ready]
        out, lo, hi = [], 0, 0
        for at, event in ready:
            while times[lo] <= at - span:
                lo += 1
            while hi < len(times) and times[hi] <= at:
                hi += 1
            out.append((key[0], event, hi - lo, hi - lo > limit))
        later = [(waiting[i], ids[i]) for i in order if waiting[i] > mark]
        times = [t for t in times if t > mark - span]
        if later or times:
            state.update((times, [at for at, _ in later], [event for _, event in later]))
            due = later[0][0] if later else times[-1] + span
            state.setTimeoutTimestamp(max(due // 1000 + 1, mark // 1000 + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "recent", "limited"])

    return events.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, event_id long, recent long, limited boolean", "times array<long>, waiting array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
