"""Summary trees with soft membership: a node may have several parents, and a search looks at all levels at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import durable
from .vector import norm, top_k


#: Rows, those with the smallest hashes of their node, among which a mixture's first means are picked, far from each other.
START_ROWS = 2000


@dataclass
class Mixture:
    """Gaussians with a variance of their own in each dimension: as many numbers as parts times dimensions."""

    shares: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of share times density of each row in each part."""
        steps = ((x[:, None, :] - self.means) ** 2 / self.variances + np.log(self.variances)).sum(axis=2)
        return np.log(self.shares) - 0.5 * steps

    def probability(self, vector: Column) -> Column:
        @F.arrow_udf("array<double>")
        def of(column: pa.Array) -> pa.Array:
            own = self.logs(np.array(column.to_pylist(), np.float64))
            own = np.exp(own - own.max(axis=1, keepdims=True))
            return pa.array(list(own / own.sum(axis=1, keepdims=True)), pa.list_(pa.float64()))

        return of(vector)

    def sums(self, batches):
        """Of a partition: log likelihood, then each part's weight, and weighted sums of steps from its mean and of their squares."""
        total = 0.0
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                x = np.array(batch.column(0).slice(lo, 1024).to_pylist(), np.float64)
                own = self.logs(x)
                top = own.max(axis=1, keepdims=True)
                like = np.exp(own - top)
                weight = like / like.sum(axis=1, keepdims=True)
                step = x[:, None, :] - self.means
                total = total + np.concatenate([[(top[:, 0] + np.log(like.sum(axis=1))).sum()], weight.sum(axis=0), (weight[:, :, None] * step).sum(axis=0).ravel(), (weight[:, :, None] * step**2).sum(axis=0).ravel()])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])


def mixture(rows: DataFrame, parts: int, rounds: int, seed: int) -> Mixture:
    """A mixture fitted on all `rows` (node, embedding) by expectation and maximisation; a round is one scan that sums by partition. Rounds end when the likelihood stands still."""
    start = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(START_ROWS).collect()], np.float64)
    picked, far = [0], ((start - start[0]) ** 2).sum(axis=1)
    while len(picked) < parts:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((start - start[picked[-1]]) ** 2).sum(axis=1))
    spread = start.var(axis=0)
    floor = 1e-3 * spread.mean() + 1e-12  # no part shrinks to a point
    own = Mixture(np.full(parts, 1 / parts), start[picked], np.tile(np.maximum(spread, floor), (parts, 1)))
    last, d = -np.inf, start.shape[1]
    for _ in range(rounds):
        found = rows.select("embedding").mapInArrow(own.sums, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        s = np.array([r["x"] for r in found])
        like, weight = s[0], s[1 : 1 + parts]
        first, second = s[1 + parts : 1 + parts + parts * d].reshape(parts, d), s[1 + parts + parts * d :].reshape(parts, d)
        some = np.maximum(weight, 1e-9)[:, None]
        own = Mixture(np.maximum(weight, 1e-9) / np.maximum(weight, 1e-9).sum(), own.means + first / some, np.maximum(second / some - (first / some) ** 2, floor))
        if abs(like - last) <= 1e-6 * abs(like):
            break
        last = like
    return own


def grown(vectors: DataFrame, levels: int = 3, most: int = 10, least: float = 0.1, rounds: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a tree over vectors (node, embedding): node, level, embedding, child_count; child, parent, weight.

    A level of n nodes is cut by a Gaussian mixture of n // 3 parts, 2 at least and `most` at most, which is fitted on
    all of them. A node has each part as a parent that it belongs to with a probability of at least
    `least`, and the likeliest in any case; a parent's vector is the mean of its children by these weights. Levels end
    at one node, or after `levels`. The given nodes are level 0, with numbers below 2^32; a parent's number is its level
    times 2^32 plus its part. Null vectors, and those of another length than the first, are left out. Of nodes that all
    have one vector, the mixture's parts are alike, and each node has all of them that its probabilities allow.
    """
    whole = vectors.where("embedding is not null").select(F.col("node").cast("long").alias("node"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = whole.select(F.size("embedding").alias("d")).first()
    rows = durable(whole.where(F.size("embedding") == (width["d"] if width else 0)))
    nodes = rows.select("node", F.lit(0).alias("level"), "embedding", F.lit(0).cast("long").alias("child_count"))
    links = rows.limit(0).select(F.col("node").alias("child"), F.col("node").alias("parent"), F.lit(0.0).alias("weight"))
    for level in range(1, levels + 1):
        n = rows.count()
        if n < 2:
            break
        parts = min(most, max(2, n // 3))
        own = mixture(rows, parts, rounds, seed)
        each = rows.select("node", "embedding", F.posexplode(own.probability(F.col("embedding"))).alias("part", "p"))
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("p"), "part"))
        kept = durable(each.withColumn("r", best).where((F.col("p") >= least) | (F.col("r") == 1)).select("node", "embedding", (F.lit(level).cast("long") * (1 << 32) + F.col("part")).alias("parent"), F.greatest("p", F.lit(1e-12)).alias("weight")))
        links = links.unionAll(kept.select(F.col("node").alias("child"), "parent", "weight"))
        sums = kept.select("parent", "weight", F.posexplode("embedding").alias("i", "x")).groupBy("parent", "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
        means = sums.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("embedding"))
        count = kept.groupBy("parent").agg(F.count(F.lit(1)).alias("child_count"))
        above = durable(means.join(count, "parent").select(F.col("parent").alias("node"), F.lit(level).alias("level"), "embedding", "child_count"))
        nodes, rows = nodes.unionAll(above), above.select("node", "embedding")
    return nodes, links


def search(nodes: DataFrame, queries: DataFrame, k: int, level: int | None = None) -> DataFrame:
    """query_id, node, level, score, rank: the k nodes nearest to each query (query_id, q), of one level or of all; ties by node. Zero vectors score 0."""
    own = nodes if level is None else nodes.where(F.col("level") == level)
    found = top_k(queries, own.select(F.col("node").alias("vec_id"), "embedding"), k)
    return found.withColumnRenamed("vec_id", "node").join(own.select("node", "level"), "node").select("query_id", "node", "level", "score", "rank")


def leaves(links: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: everything without children that lies below each root (node), itself if it has none; by one join a level, each written out."""
    inner = links.select("parent").distinct()
    front, out = durable(roots.select(F.col("node").alias("root"), "node").distinct()), None
    while True:
        ends = front.join(inner, front["node"] == inner["parent"], "left_anti")
        out = ends if out is None else out.unionAll(ends)
        front = durable(front.join(links.select(F.col("parent").alias("node"), "child"), "node").select("root", F.col("child").alias("node")).distinct())
        if front.isEmpty():
            return out.distinct()


def entities_below(links: DataFrame, mentions: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """root, eid, mentions: entities that the leaves (sid of mentions) below each root (node) mention, the most frequent first (ties by eid), `most` of them or all."""
    below = leaves(links, roots).join(mentions.select(F.col("sid").alias("node"), "eid"), "node")
    count = below.groupBy("root", "eid").agg(F.count(F.lit(1)).alias("mentions"))
    if most is None:
        return count
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mentions"), "eid"))
    return count.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def coherence(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, coherence: mean cosine of a parent and its children."""
    dot = F.aggregate(F.zip_with("up", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = norm(F.col("up")) * norm(F.col("embedding"))
    near = links.join(nodes.select(F.col("node").alias("parent"), F.col("embedding").alias("up")), "parent").join(nodes.select(F.col("node").alias("child"), "embedding"), "child")
    return near.groupBy(F.col("parent").alias("node")).agg(F.round(F.avg(F.when(length > 0, dot / length).otherwise(0.0)), 6).alias("coherence"))
