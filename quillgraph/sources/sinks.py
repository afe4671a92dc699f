"""Sinks: tables partitioned by tenant, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stamp(df: DataFrame, tenant: str) -> DataFrame:
    """Adds group_id where it is missing; no row leaves without a tenant."""
    own = F.coalesce("group_id", F.lit(tenant)) if "group_id" in df.columns else F.lit(tenant)
    return df.withColumn("group_id", own)


def write_table(df: DataFrame, path: str, tenant: str, mode: str = "overwrite") -> None:
    """Parquet by tenant; with dynamic overwrite only the tenant's own partition is replaced."""
    stamp(df, tenant).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("group_id").parquet(path)


def write_json(df: DataFrame, path: str, tenant: str) -> None:
    stamp(df, tenant).write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: list[str], tenant: str) -> int:
    """Appends the rows whose key the table does not have yet; returns how many."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).where(F.col("group_id") == tenant).select(*key)
        fresh = df.dropDuplicates(key).join(there, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df.dropDuplicates(key)
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        write_table(fresh, path, tenant, "append")
    fresh.unpersist()
    return n


def ensure_table(df: DataFrame, name: str, partition: str = "group_id") -> bool:
    """Creates a partitioned Parquet table with the columns of `df` if it is not there; returns whether it did. An index is not needed: the partition prunes by tenant."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        return False
    stamp(df.limit(0), "").write.partitionBy(partition).format("parquet").saveAsTable(name)
    return True


def write_index(mentions: DataFrame, path: str, tenant: str) -> None:
    """An inverted index as JSON: of each entity (eid) its sentences (sid), in rows of at most 1,000 ids, so that a frequent entity makes no unbounded value."""
    part = F.floor(F.row_number().over(Window.partitionBy("eid").orderBy("sid")) / 1001)
    rows = mentions.distinct().withColumn("part", part).groupBy("eid", "part").agg(F.sort_array(F.collect_list("sid")).alias("sids"))
    write_json(rows, path, tenant)


def append_usage(events: DataFrame, path: str, tenant: str) -> int:
    """Appends usage facts, one row an event_id, whatever their type; repeats are not written twice."""
    return append_new(events, path, ["event_id"], tenant)
