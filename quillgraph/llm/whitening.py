"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR.

Each block of rows is centred on its own mean and compressed to the triangle R
of its QR factors, with its row count and exact sums. Two blocks combine to the
triangle of both triangles and one more row, the weighted difference of their
means, so that the last one is the R of all rows centred on the common mean
after a single scan. Blocks meet in a tree, FAN_IN at a time on the executors;
what reaches the driver is one triangle, bounded by the vector's length. There,
plane rotations make R's columns orthogonal: the rotations accumulate to the
components, and the columns' lengths are the standard deviations times the root
of n, to full precision also where they are small.

Rows whose vector is null or holds null or non-finite entries are left out. An
entry c counts as x = floor(64 c) + 1000000. Vectors should have one length:
rows of another length than the most frequent one (of ties the longest) are
left out too. A component whose deviation is zero to working precision (fewer
distinct vectors than dimensions) has no whitened value and is not returned. A
component's largest entry is positive. Repeated rows and ids count each; an
empty table, and one without spread, gives an empty result. Further columns are
not kept. A deviation beyond the range of a long is null, and so are entries'
parts beyond 2^52 cut to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

COMPONENTS = 32
#: x = floor(SCALE c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block, and blocks that are combined by one task.
ROWS, FAN_IN = 4096, 16
MOST = float(1 << 52)

_BLOCK = "part long, n long, high array<long>, low array<long>, r array<double>"
_LOW = (1 << 32) - 1


def scaled(vectors: pa.Array) -> np.ndarray:
    """The x-vectors of lists of equal length, as a matrix of long."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64).reshape(len(vectors), -1) + SHIFT


@dataclass
class Block:
    """Rows compressed: count, exact sums, and the triangle of the rows centred on their mean."""

    n: int
    sums: list[int]
    r: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        sums = [(h << 32) + low for h, low in zip((x >> 32).sum(axis=0).tolist(), (x & _LOW).sum(axis=0).tolist(), strict=True)]
        return cls(len(x), sums, _triangle(centred(x, len(x), sums)))

    def __add__(self, other: Block) -> Block:
        # exact difference of means before rounding: (S m - T n) / (n m), weighted by the root of n m / (n + m)
        n, m = self.n, other.n
        step = np.array([(s * m - t * n) / (n * m) for s, t in zip(self.sums, other.sums, strict=True)]) * math.sqrt(n * m / (n + m))
        return Block(n + m, [s + t for s, t in zip(self.sums, other.sums, strict=True)], _triangle(np.vstack([self.r, other.r, step])))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off exactly, then its fraction."""
    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)) - np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def _triangle(rows: np.ndarray) -> np.ndarray:
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else rows
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _row(part: int, block: Block) -> pa.RecordBatch:
    columns = [[part], [block.n], [[s >> 32 for s in block.sums]], [[s & _LOW for s in block.sums]], [block.r.ravel()]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "n", "high", "low", "r"])


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for row in batch.to_pylist():
        d = len(row["high"])
        yield Block(row["n"], [(h << 32) + low for h, low in zip(row["high"], row["low"], strict=True)], np.array(row["r"]).reshape(d, d))


def _summed(parts: Iterator[Block]) -> Block | None:
    total = None
    for block in parts:
        total = block if total is None else total + block
    return total


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    own = (Block.of(scaled(batch.column("v").slice(lo, ROWS))) for batch in batches for lo in range(0, len(batch), ROWS))
    if (total := _summed(own)) is not None:
        yield _row(TaskContext.get().partitionId(), total)


def _combine(part: int):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (total := _summed(b for batch in batches for b in _blocks(batch))) is not None:
            yield _row(TaskContext.get().partitionId() if part else 0, total)

    return combine


def compressed(vectors: DataFrame) -> Block | None:
    """All rows of `vectors` (column v) as one block; None without rows."""
    blocks = durable(vectors.select("v").mapInArrow(_compress, _BLOCK))
    count = blocks.agg(F.max("part")).first()[0]
    parts = 0 if count is None else count + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        blocks = blocks.repartition(parts, F.floor(F.col("part") / FAN_IN)).mapInArrow(_combine(parts), _BLOCK) if parts > 1 else blocks.coalesce(1).mapInArrow(_combine(0), _BLOCK)
        blocks = durable(blocks)
    found = blocks.toArrow().to_batches()
    return _summed(b for batch in found for b in _blocks(batch))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of a square matrix, by plane rotations of pairs of its columns.

    A sweep takes all pairs in rounds of disjoint ones, which are rotated together.
    """
    d = r.shape[1]
    size = d + d % 2
    u, v = np.zeros((len(r), size)), np.eye(size)
    u[:, :d] = r
    seats = np.arange(size)
    floor = (np.finfo(float).eps * np.sqrt((u**2).sum())) ** 2  # a column below this is zero
    for _ in range(sweeps):
        turned = False
        for _ in range(size - 1):
            a, b = seats[: size // 2], seats[size // 2 :][::-1]
            ua, ub = u[:, a], u[:, b]
            alpha, beta, gamma = (ua**2).sum(axis=0), (ub**2).sum(axis=0), (ua * ub).sum(axis=0)
            act = (np.abs(gamma) > 4 * np.finfo(float).eps * np.sqrt(alpha * beta)) & (alpha > floor) & (beta > floor)
            if act.any():
                turned = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    zeta = (beta - alpha) / (2 * gamma)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta**2))
                t = np.where(act, t, 0.0)
                c = 1 / np.sqrt(1 + t**2)
                s = c * t
                u[:, a], u[:, b] = c * ua - s * ub, s * ua + c * ub
                va, vb = v[:, a], v[:, b]
                v[:, a], v[:, b] = c * va - s * vb, s * va + c * vb
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    length = np.sqrt((u**2).sum(axis=0))
    real = np.flatnonzero(np.abs(v[:d]).sum(axis=0) > 0.5)[: size]
    order = real[np.argsort(-length[real], kind="stable")][:d]
    return length[order], v[:d, order]


@dataclass
class Model:
    """n, exact sums, the components that are kept (as columns), their standard deviations, and their shares of all variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / self.deviations


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of all rows of `vectors` (column v, lists of one length); None without rows or spread."""
    block = compressed(vectors)
    if block is None or not block.sums:
        return None
    length, v = jacobi(block.r)
    keep = min(components, int((length > length[0] * 1e-13 * len(length)).sum())) if length[0] > 0 else 0
    if not keep:
        return None
    v = v[:, :keep]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(keep)])
    return Model(block.n, block.sums, v, length[:keep] / math.sqrt(block.n), length[:keep] ** 2 / (length**2).sum())


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v of the rows whose vector has the usual length and only finite entries."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))))  # NaN is above infinity here
    usual = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("v") == (usual["d"] if usual else 0))


def _moments(model: Model):
    """Count, mean and centred products of the whitened rows of a partition, by blocks."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, 0.0, 0.0
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                w = model.whiten(scaled(batch.column("v").slice(lo, ROWS)))
                m, own = len(w), w.mean(axis=0)
                step = own - mean
                products = products + (w - own).T @ (w - own) + np.outer(step, step) * (n * m / (n + m))
                mean = mean + step * (m / (n + m))
                n += m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean], pa.list_(pa.float64())), pa.array([products.ravel()], pa.list_(pa.float64()))], names=["n", "mean", "products"])

    return moments


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = model.components.shape[1]
    parts = durable(vectors.select("v").mapInArrow(_moments(model), "n long, mean array<double>, products array<double>"))
    means = {r["i"]: r["mean"] for r in parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    mean = F.array(*[F.lit(float(means[i])) for i in range(k)])
    step = F.zip_with("mean", mean, lambda a, b: a - b)
    entries = (
        parts.select("n", "products", step.alias("step")).select("n", F.posexplode("products").alias("at", "c"), "step")
        .withColumn("i", F.floor(F.col("at") / k).cast("int")).withColumn("j", F.col("at") % k)
        .groupBy("i", "j").agg((F.sum(F.col("c") + F.col("n") * F.get("step", F.col("i")) * F.get("step", F.col("j"))) / F.sum("n")).alias("cov"))
    )
    return float(entries.agg(F.max(F.abs(F.col("cov") - (F.col("i") == F.col("j")).cast("double")))).first()[0])


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    step = x - whole
    largest = int(np.abs(step).max(initial=0)) + 1
    if x.shape[1] * (largest * n) ** 2 < 1 << 63:
        return ((step * n - rest) ** 2).sum(axis=1).tolist()
    out = [sum((a * n - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in step.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def _whitened(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.components.shape[1]
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                x = scaled(part.column("v"))
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(model.explained, len(x))),
                    ],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    return rows


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    kind = "vec_id long, component int, deviation long, whitened double, explained double"
    order = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    vectors = usable(embeddings)
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], kind).select(*order[:2], F.lit(0).cast("long").alias("n"), *order[3:6], F.lit(0.0).alias("identity_error"))
    error = identity_error(vectors, model)
    rows = vectors.mapInArrow(_whitened(model), kind)
    return rows.withColumn("n", F.lit(model.n).cast("long")).withColumn("identity_error", F.lit(error)).select(*order)
