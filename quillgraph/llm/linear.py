"""What the two text classifiers share: the sample they learn from, and scoring.

A document is a training row if ``crc32(doc_id as text) mod 3 <> 1`` and it has
a label.  A model is fitted on at most ``fit_rows`` such rows, those with the
smallest hash of their doc_id, so that the sample is the same whatever the
cluster does.  Only ids and labels are gathered to choose the sample; its texts
are found by a broadcast of at most ``fit_rows`` ids and turned to features on
the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec

Featurizer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from (a null id hashes as the empty text and is no training row's key)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(documents: DataFrame, labels: DataFrame, label: str, fit_rows: int, featurize: Featurizer) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and 0/1 labels of the bounded sample.

    Labels that are null, or have no id, are ignored; several labels of one id
    count as their mean, rounded; documents that repeat an id each count, up to
    `fit_rows` in all.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .where("_id is not null and _y is not null")
        .where(~held_out(F.col("_id")))
        .groupBy("_id")
        .agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_rows)
    )
    rows = (
        documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .select("_id", "_y", "_text")
    )

    def features(batches):
        for batch in batches:
            data, offsets = textvec.utf8(batch.column(2))
            for lo, hi in textvec.groups(offsets):
                indptr, indices = featurize(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(indptr.astype(np.int32)), pa.array(indices))],
                    names=["id", "y", "f"],
                )

    # the same order and bound again: ids may repeat among the documents
    found = rows.mapInArrow(features, "id long, y int, f array<int>").orderBy(F.xxhash64("id"), "id", F.xxhash64("f")).limit(fit_rows)
    data, labels_found = [], []
    for batch in found.toArrow().to_batches():  # views of the batches: nothing is copied
        lists = batch.column(2)
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        data += [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        labels_found.append(batch.column(1).to_numpy())
    return data, np.concatenate(labels_found).astype(np.int64) if labels_found else np.zeros(0, np.int64)


def blocks(rows: list[np.ndarray], size: int = 256):
    """Rows joined block by block: (first row, lengths, features)."""
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        yield lo, [len(r) for r in part], np.concatenate(part)


def frequencies(rows: list[np.ndarray], dim: int) -> np.ndarray:
    """How many rows have each feature."""
    out = np.zeros(dim, np.int32)
    for _, _, flat in blocks(rows):
        flat.sort()
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        out[flat[first]] += np.diff(np.append(first, len(flat))).astype(np.int32)
    return out


def only(rows: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
    """Each row without the features that `keep` does not mark."""
    out: list[np.ndarray] = []
    for _, lengths, flat in blocks(rows):
        kept = keep[flat]
        ends = np.cumsum(lengths)
        at = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        flat = flat[kept]
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def release() -> None:
    """Gives memory that is no longer used back to the system; the driver lives on after a fit, and a worker waits for its next task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def margin(data: np.ndarray, offsets: np.ndarray, featurize: Featurizer, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct features."""
    out = np.zeros(len(offsets) - 1)
    for lo, hi in textvec.groups(offsets):
        indptr, indices = featurize(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        owner = np.repeat(np.arange(hi - lo), np.diff(indptr))
        out[lo:hi] = np.bincount(owner, weights=weights[indices], minlength=hi - lo)
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through margins, by Newton's method with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g = p - target
        w = np.maximum(p * (1 - p), 1e-9)
        h11, h12, h22 = (w * margins**2).sum() + 1e-6, (w * margins).sum(), w.sum() + 1e-6
        g1, g2 = (g * margins).sum(), g.sum()
        det = h11 * h22 - h12 * h12
        if det <= 1e-12:
            break
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-6)), float(b)
