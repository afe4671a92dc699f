"""Exact vector search and similarity edges in double precision, JVM-side.

A small query set is broadcast against all rows. Large ones, and comparisons
of a corpus with itself, deal both sides to blocks, and tasks compare blocks
with matrix products.
"""

from __future__ import annotations

import sys
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import durable


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either is null, empty or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    length = norm(a) * norm(b)
    return F.coalesce(F.when(length > 0, dot / length), F.lit(0.0))


#: Most queries that are broadcast.
QUERY_BLOCK = 4096


def _unit_rows(column) -> np.ndarray:
    """Rows of a list column at unit length, in double precision; null and zero vectors are zero."""
    lists = column.to_pylist()
    width = max((len(v) for v in lists if v), default=1)
    x = np.array([v if v is not None and len(v) == width else np.zeros(width) for v in lists], dtype=np.float64).reshape(len(lists), width)
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None]


#: Vectors of one block of an all-pairs comparison, and of one block that large query sets are compared with.
BLOCK_ROWS = 4096


def top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest of `vectors` (vec_id, embedding) for each query (query_id, q); ties by vec_id.

    Up to QUERY_BLOCK queries are broadcast as a matrix, and a batch of vectors
    sends on only what can still be among the k best of a query. More queries
    are dealt to blocks like the vectors, and tasks compare a block of each.
    """
    found = _found(queries, vectors, k, least, digits)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def every(queries: DataFrame, vectors: DataFrame, least: float | None = None, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score of all vectors (of at least `least`) for each of a stated set of queries, unranked."""
    return _found(queries, vectors, sys.maxsize, least, digits)


def _found(queries: DataFrame, vectors: DataFrame, k: int, least: float | None, digits: int) -> DataFrame:
    many = queries.select("query_id").limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK
    return _by_blocks(queries, vectors, k, least, digits) if many else _by_broadcast(queries, vectors, k, least, digits)


def _best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: float | None, digits: int):
    """(query_id, vec_id, score) of what can be among the k best of each query, 512 queries at a time."""
    if not len(ids) or not len(qid) or x.shape[1] != q.shape[1]:
        return
    for lo in range(0, len(qid), 512):
        score = np.round(q[lo : lo + 512] @ x.T, digits)
        floor = np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
        i, j = np.nonzero((score >= floor) & (score >= (-np.inf if least is None else least)))
        yield pa.RecordBatch.from_arrays([pa.array(qid[lo + i]), pa.array(ids[j]), pa.array(score[i, j])], names=["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score double"


def _by_broadcast(queries: DataFrame, vectors: DataFrame, k: int, least: float | None, digits: int) -> DataFrame:
    part = queries.select("query_id", "q").limit(QUERY_BLOCK).toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((part.column("query_id").to_numpy(), _unit_rows(part.column("q"))))

    def best(batches):
        for batch in batches:
            yield from _best(*shared.value, batch.column("vec_id").to_numpy(zero_copy_only=False), _unit_rows(batch.column("embedding")), k, least, digits)

    return vectors.select("vec_id", "embedding").mapInArrow(best, _FOUND)


def _dealt(rows: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Every row in its own block, once for each block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, least: float | None, digits: int) -> DataFrame:
    qb, vb = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (queries, vectors))
    left = _dealt(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks")), "id", "i", qb, "j", vb)
    right = _dealt(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(False).alias("asks")), "id", "j", vb, "i", qb)

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), _unit_rows(table.column("v"))
        out = list(_best(ids[asks], x[asks], ids[~asks], x[~asks], k, least, digits))
        return pa.Table.from_batches(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return left.unionByName(right).groupBy("i", "j").applyInArrow(compare, _FOUND)


def _near(least: float):
    """Pairs with a cosine of at least `least` between the rows of block `i` and of block `j` of a group (or inside the one)."""

    def near(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        ids, x = table.column("vec_id").to_numpy(), _unit_rows(table.column("embedding"))
        a, b = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("i", "j"))
        first, second, scores = [], [], []
        for lo in range(0, len(a), 1024):
            score = x[a[lo : lo + 1024]] @ x[b].T
            i, j = np.nonzero(score >= least - 1e-9)
            u, v = ids[a[lo + i]], ids[b[j]]
            keep = u < v if table.column("i")[0].as_py() == table.column("j")[0].as_py() else u != v
            first.append(np.minimum(u, v)[keep])
            second.append(np.maximum(u, v)[keep])
            scores.append(score[i, j][keep])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"a": join(first, pa.int64()), "b": join(second, pa.int64()), "score": join(scores, pa.float64())})

    return near


def similar_pairs(vectors: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a < b, score of all pairs with cosine of at least `least`, from (vec_id, embedding).

    Vectors are dealt to blocks of about `block_rows` by a hash of their id, and
    a task compares two blocks by matrix products: nothing goes through the
    driver, memory is bounded by two blocks, and the work is the square, as
    exact all-pairs similarity is. `banded_pairs` does less and may miss some.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    rows = _dealt(vectors.select("vec_id", "embedding"), "vec_id", "own", blocks, "other", blocks)
    pairs = rows.select("vec_id", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return pairs.groupBy("i", "j").applyInArrow(_near(least), "a long, b long, score double").withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def bands_for(least: float, rows: int, recall: float = 0.97) -> tuple[int, int]:
    """(bits of a band, bands): buckets of some 64 rows, and as many bands as find a pair of similarity `least` with probability `recall`.

    A random plane parts two vectors with the probability of their angle over 180 degrees.
    """
    bits = max(4, math.ceil(math.log2(max(rows, 1) / 64)))
    same = (1 - math.acos(min(max(least, -1.0), 1.0)) / math.pi) ** bits
    return bits, 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def banded_pairs(vectors: DataFrame, least: float, recall: float = 0.97, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a < b, score of pairs with cosine of at least `least`: all that share a bucket in one of the bands of random hyperplanes, verified exactly.

    A pair just at `least` is found with probability `recall` (more alike ones with more); `similar_pairs` finds all.
    Bits and bands follow from the number of rows, so buckets stay small while it grows. A crowded bucket is dealt to
    blocks that are compared two by two. Null and zero vectors, and those of another length than the first, are in no
    pair.
    """
    rows = vectors.select("vec_id", "embedding").where(norm(F.col("embedding")) > 0)
    first = rows.select(F.size("embedding").alias("d")).first()
    if first is None:
        return similar_pairs(rows, least)
    rows, width = rows.where(F.size("embedding") == first["d"]), first["d"]
    bits, bands = bands_for(least, rows.count(), recall)

    @F.arrow_udf("array<long>")
    def codes(column: pa.Array) -> pa.Array:
        planes = np.random.default_rng(seed).normal(size=(width, bands * bits))
        side = (_unit_rows(column) @ planes > 0).reshape(len(column), bands, bits)
        return pa.array(list((side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)), pa.list_(pa.int64()))

    keys = durable(rows.select("vec_id", F.posexplode(codes(F.col("embedding"))).alias("band", "code")))
    size = keys.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "code", F.ceil(F.col("n") / block_rows).alias("blocks"))
    met = keys.join(size, ["band", "code"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("vec_id", "band", "code", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = dealt.join(rows, "vec_id").groupBy("band", "code", "i", "j").applyInArrow(_near(least), "a long, b long, score double")
    return found.withColumn("score", F.round("score", 6)).where(F.col("score") >= least).groupBy("a", "b").agg(F.max("score").alias("score"))


def capped_edges(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs that are among the `most` best of both their ends (ties by the other end's id): a mutual nearest-neighbour graph."""
    ends = pairs.select("a", "b", "score")
    both = ends.select(F.col("a").alias("own"), F.col("b").alias("other"), "score").unionAll(ends.select(F.col("b").alias("own"), F.col("a").alias("other"), "score"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "other"))).where(F.col("r") <= most)
    pair = best.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "score")
    return pair.groupBy("a", "b").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def nearest_rank(df: DataFrame, value: str, shares: list[float], ranges: int = 256) -> DataFrame:
    """share, value: exact nearest-rank percentiles of all rows that are not null.

    Approximate quantiles cut the values into ranges (a small table); counts of
    the ranges tell in which one each rank lies, and only those are ordered.
    """
    rows = df.select(F.col(value).alias("v")).where("v is not null")
    cuts = sorted(set(rows.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    ranged = rows.withColumn("b", at)
    counts = {r["b"]: r["n"] for r in ranged.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, asked = sum(counts.values()), []
    for s in shares if total else []:
        rank, before = max(1, -(-int(round(s * total * 10**9)) // 10**9)), 0
        for b in sorted(counts):
            if rank <= before + counts[b]:
                asked.append((s, b, rank - before))
                break
            before += counts[b]
    wanted = df.sparkSession.createDataFrame(asked, "share double, b int, r long")
    own = ranged.join(F.broadcast(wanted.select("b").distinct()), "b", "left_semi").groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    run = own.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("v")))
    return run.join(F.broadcast(wanted), "b").where("upto >= r").groupBy("share").agg(F.min("v").alias("value"))
