"""Packing into optimal length buckets.

The lengths of all texts make one histogram; dynamic programming over it
chooses the bucket bounds that minimise padding for a given number of
buckets. Inside each bucket rows form batches of ``token_budget // bound``
rows, so that no padded batch exceeds the budget. A row longer than the budget
is a batch of its own and marked in `over_budget`.

The histogram has one bin for each length that occurs, so its size is bounded
by the longest text and not by the number of rows, and the bounds are the
best there are.

Lengths are words by default; the query and the pipeline count tokens with
`token_counts.n_tokens`, and `length` may be any other count. A null text has length 0 and goes to the first
bucket. Rows of equal text have equal lengths and may share a bucket and a
batch. An empty table gives an empty result; further columns are not kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .numbering import numbered

BUCKETS, TOKEN_BUDGET, LANES = 16, 32768, 1024


def words(text: Column) -> Column:
    """Length in words parted by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bounds, of `lengths`, with the least total padding; `lengths` ascend.

    With b rows up to the i-th length, a bucket of the lengths i+1 .. j costs
    length_j * (b_j - b_i) less a constant: for each i a line in length_j. Lines
    come with falling slopes and are asked at growing places, so each layer
    walks along their lower hull once. All numbers are whole.
    """
    m = len(lengths)
    if m == 0:
        return []
    k = min(buckets, m)
    bound = [int(x) for x in lengths]
    total = [0]
    for c in counts:
        total.append(total[-1] + int(c))
    infinite = 1 << 100
    best = [0] + [infinite] * m
    choice = np.zeros((k, m + 1), np.int64)
    for layer in range(k):
        new = [infinite] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i)
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] < infinite:
                line = (-total[j - 1], best[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = bound[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            slope, height, i = hull[at]
            new[j], choice[layer, j] = slope * x + height + x * total[j], i
        best = new
    bounds, j = [], m
    for layer in range(k - 1, -1, -1):
        bounds.append(bound[j - 1])
        j = int(choice[layer, j])
        if j == 0:
            break
    return sorted(set(bounds))


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bounds for a table with a column n_tokens, from the histogram over all its rows."""
    bins = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    return best_bounds(bins.column("n_tokens").to_numpy(), bins.column("n").to_numpy(), buckets)


def pack(documents: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, id_col: str = "doc_id", text_col: str = "text", length=words) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding and over_budget of every row.

    `batch` numbers the batches of a bucket from 0, `slot` the rows of a batch.
    Rows that repeat an id are rows of their own.
    """
    text = F.col(text_col).cast("string")
    slim = durable(documents.select(F.col(id_col).alias("doc_id"), length(text).alias("n_tokens"), F.xxhash64(text).alias("__h")))
    bounds = bucket_bounds(slim, buckets)
    if not bounds:
        bounds = [0]
    number, bound = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        fits = F.col("n_tokens") <= bounds[i]
        number, bound = F.when(fits, i).otherwise(number), F.when(fits, F.lit(bounds[i])).otherwise(bound)
    rows = slim.withColumns({"bucket": number.cast("int"), "bucket_len": bound.cast("long")})
    rows = numbered(rows, [F.col("doc_id"), F.col("n_tokens"), F.col("__h")], "__i", within=["bucket"], lanes=LANES)
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("__i") / capacity).cast("long").alias("batch"),
        (F.col("__i") % capacity).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        (F.col("n_tokens") > token_budget).alias("over_budget"),
    )
