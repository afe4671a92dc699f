"""Cutting the lineage of iterative plans so that lost executors cost one round."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, stem: str) -> str:
    """The name of a new folder in the one in spark.checkpoint.dir (a local one only where that is unset)."""
    context = spark.sparkContext
    inner = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (inner.get() if inner.isDefined() else None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        context.setCheckpointDir(folder)
    return f"{folder}/{stem}-{uuid4()}"


def durable(df: DataFrame) -> DataFrame:
    """The rows of `df`, written as a table to a new folder and read from there.

    A checkpoint would work out the rows twice, once to see them and once to write them.
    """
    path = new_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(df: DataFrame, most: int = 10_000) -> DataFrame:
    """`df`, which is cheap to count, for a join: broadcast if it has at most `most` rows, else both sides are sorted.

    Spark's own choice goes by the size of files, and may send the rows that an explode makes through the driver.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
