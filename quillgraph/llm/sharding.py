"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. n-1 (order: lane of a hash, doc_id, checksum, size of
the text); a keyed balanced Feistel network permutes the numbers below the
next power of four, and a number that lands at n or above walks on until it
falls below.  Of the permuted position p, ``p mod shards`` is the shard and
``p div shards`` the slot: shard and slot of any row number are computable
without the data, and shard sizes differ by at most one.

Null texts have size 1 and checksum 0; texts of any length are measured whole.
Equal texts are rows of their own: each has a number, and so a shard, by
itself, and rows that agree in id, size and checksum may swap numbers.  An
empty table gives an empty result; further columns are not kept.

The texts are read once: ids, sizes and checksums are written to the shared
checkpoint folder, and counts and numbers come from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .numbering import numbered

ROUNDS = 6


def _round(half: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Positions of row numbers in the seeded permutation of 0 .. n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right, (seed * 0x100000001B3 + r * 0x632BE5AB) & (2**64 - 1)) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def shard(documents: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard (null: the law is `rows`) of every row."""
    text = F.col(text_col).cast("string")
    slim = durable(
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        )
    )
    total = slim.agg(F.count(F.lit(1)).alias("__n"))
    rows = numbered(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "row_number").crossJoin(F.broadcast(total))  # one row

    @F.arrow_udf("long")
    def position(number: pa.Array, n: pa.Array) -> pa.Array:
        if not len(number):
            return pa.array([], pa.int64())
        return pa.array(permute(number.to_numpy(zero_copy_only=False), int(n[0].as_py()), seed))

    p = F.col("__p")
    return rows.withColumn("__p", position("row_number", "__n")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (p % shards).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
