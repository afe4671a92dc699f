"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is made only where none is set, as in tests."""
    context = spark.sparkContext
    inner = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if inner.isEmpty():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or tempfile.mkdtemp(prefix="quillgraph-checkpoint-")
        context.setCheckpointDir(folder)
    return folder or inner.get()


def durable(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a compressed Parquet table in the shared folder: a smaller copy than a checkpoint, for tables that are large or read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
