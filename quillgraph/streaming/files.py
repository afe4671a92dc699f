"""File events to table changes: uploads replace a document's rows, deletions take them away.

The table is dealt to parts by a hash of the path. A batch of events reads and
rewrites the parts that it touches and leaves the files of all others as they
are. Its rows go to a generation of their own; a manifest that says which
generation each part has is written last, so a batch counts whole or not at
all, and one that comes again after it counted is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a new table: what a batch that touches one path rewrites is the table's size over this.
PARTS = 64
ROWS = "path string, content string"


def changes(batch: DataFrame) -> DataFrame:
    """The last event (event_id, path, kind, content) of each path."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("event_id")))
    return batch.withColumn("r", last).where("r = 1").drop("r")


def apply_changes(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table (path, content) after a batch of events: `uploaded` paths have the new content, `deleted` ones are gone."""
    last = changes(batch)
    return table.join(last.select("path"), "path", "left_anti").unionByName(last.where("kind = 'uploaded'").select("path", "content"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches whose manifest is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    there = [f.getPath() for f in fs.listStatus(path)]
    done = [p.getName() for p in there if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done if n.startswith("version="))


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """Generation of each part that has one, by the newest manifest, or the newest before a batch. One row a part."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    return {r["part"]: r["generation"] for r in spark.read.parquet(f"{folder}/manifest/version={found[-1]}").collect()} if found else {}


def _rows(spark: SparkSession, folder: str, parts: dict[int, int]) -> DataFrame:
    """Rows of parts in their generations; other folders are not read."""
    by: dict[int, list[int]] = {}
    for part, generation in parts.items():
        by.setdefault(generation, []).append(part)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    if not by or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ROWS)
    wanted = F.lit(False)
    for generation, own in sorted(by.items()):
        wanted = wanted | ((F.col("generation") == generation) & F.col("part").isin(sorted(own)))
    return spark.read.schema(f"{ROWS}, generation long, part int").parquet(f"{folder}/data").where(wanted).select("path", "content")


def merge(batch: DataFrame, folder: str, number: int, parts: int = PARTS) -> bool:
    """Applies a batch of events to the table in `folder`; returns whether it did: a batch that counts already, or is empty, changes nothing.

    `parts` is the same for all batches of a table. Numbers of batches grow.
    """
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")
    if number in _versions(spark, folder):
        return False
    touched = [r["part"] for r in batch.select(part.alias("part")).distinct().collect()]  # no more than there are parts
    if not touched:
        return False
    known = manifest(spark, folder, number)
    old = _rows(spark, folder, {p: g for p, g in known.items() if p in touched})
    new = apply_changes(old, batch).withColumn("part", part).repartition("part")
    new.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/data/generation={number}")
    rows = sorted({**known, **dict.fromkeys(touched, number)}.items())
    spark.createDataFrame(rows, "part int, generation long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")
    return True


def follow(events: DataFrame, folder: str, checkpoint: str, parts: int = PARTS):
    """Keeps a table of files up to date with a stream of events (event_id, path, kind, content)."""
    return events.writeStream.foreachBatch(lambda batch, number: merge(batch, folder, number, parts) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest state of the table, or the newest before a batch; null if there is none."""
    known = manifest(spark, folder, before)
    return _rows(spark, folder, known) if known else None
