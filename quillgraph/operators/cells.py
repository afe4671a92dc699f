"""A cell index for vectors: k-means cells as folders of a table, and searches that read the nearest cells only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import BLOCK_ROWS, _best, _unit_rows, norm

#: Most rows that the cells are fitted on; all rows are indexed.
FIT_ROWS = 20_000


def build(vectors: DataFrame, folder: str, cells: int = 64, seed: int = 5, fit_rows: int = FIT_ROWS) -> None:
    """Writes vectors (vec_id, embedding) to `folder`/rows, in a folder for each cell, and the cells' centres to `folder`/centres.

    Centres are fitted by k-means on the `fit_rows` rows with the smallest hashes of their id. A row belongs to the
    centre of greatest cosine (ties by number). Null and zero vectors, and those of another length than the sample's
    first, are not indexed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", "embedding").where(norm(F.col("embedding")) > 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows)
    width = rows.select(F.size("embedding").alias("d")).first()
    rows = rows.where(F.size("embedding") == (width["d"] if width else 0))
    unit = lambda c: F.transform(c, lambda x: x / norm(c))
    points = sample.where(F.size("embedding") == (width["d"] if width else 0)).select(array_to_vector(unit(F.col("embedding").cast("array<double>"))).alias("features"))
    found = KMeans(k=cells, seed=seed, maxIter=15).fit(points).clusterCenters() if width else []
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cell int, centre array<double>")
    centres.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    shared = np.array(found)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        c = shared / np.maximum(np.linalg.norm(shared, axis=1), 1e-300)[:, None]
        return pa.array(np.argmax(np.round(_unit_rows(column) @ c.T, 12), axis=1).astype(np.int32))

    marked = rows.withColumn("cell", nearest(F.col("embedding")) if found else F.lit(0))
    marked.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, probe: int, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest rows of the index for each query (query_id, q), among those of its `probe` nearest cells; ties by vec_id.

    With `probe` at least the number of cells the search is exact. The cells that any query needs are named in the
    scan's partition filter, so no other folder is read; a large cell is dealt to blocks of about BLOCK_ROWS.
    """
    centres = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # as many rows as cells
    if not centres:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    c = np.array([r["centre"] for r in centres])
    c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-300)[:, None] if len(c) else c
    numbers = np.array([r["cell"] for r in centres], np.int32)

    @F.arrow_udf("array<int>")
    def cells_of(column: pa.Array) -> pa.Array:
        x = _unit_rows(column)
        if not len(c) or x.shape[1] != c.shape[1]:
            return pa.array([numbers.tolist()] * len(column), pa.list_(pa.int32()))
        order = np.argsort(-np.round(x @ c.T, 12), axis=1, kind="stable")[:, :probe]
        return pa.array(numbers[order].tolist(), pa.list_(pa.int32()))

    asked = queries.select("query_id", "q").withColumn("cell", F.explode(cells_of(F.col("q"))))
    wanted = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # no more than there are cells
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("cell").isin(wanted))
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    left = asked.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks"))
    right = rows.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(False).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), _unit_rows(table.column("v"))
        out = list(_best(ids[asks], x[asks], ids[~asks], x[~asks], k, None, digits))
        return pa.Table.from_batches(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = left.unionByName(right).groupBy("cell", "block").applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
