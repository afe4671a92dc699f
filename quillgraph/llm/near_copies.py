"""Near copies by word similarity: texts whose sets of five-word shingles are at least 0.8 alike (Jaccard).

Fingerprints within few bits cannot find these: at a similarity of 0.8 two
64-bit fingerprints differ in about 10 bits. Candidates come from MinHash:
texts that agree on all ROWS values of one of BANDS bands share a bucket. A
pair of similarity s is missed by all bands with probability
(1 - s^ROWS)^BANDS, 5e-7 at s = 0.8 and less above. Links are verified on the
whole sets, so no link is below the threshold.

Copies (equal sets) are one node. First every node is verified against the
member of each of its buckets that shares the most buckets with others: the
text that the others were made from. In buckets that this leaves in several
parts, all pairs of parts are compared, block by block: a bucket's nodes are
dealt to blocks of about BLOCK shingles (and BLOCK / EACH texts), a task compares two blocks by one
matrix product and gives links only, so a large bucket makes no pairs as
rows. A pair is compared in the first of its common buckets only.

`fingerprints` adds the links of `simhash.links`: texts whose fingerprints of
3-word shingles differ in at most 2 bits are one group whatever their sets
are. They are joined before buckets are compared, so that pairs which they
bring together are not compared again.

Words are as in `simhash.fingerprint`; a text of fewer words than a shingle
is one shingle, and texts without words (null ones too) are copies of each
other. Repeated ids are rows of their own; rows with a null id may be
dropped for another row but name no group. Texts of any length are read whole;
an empty table gives an empty result; further columns are kept by `keep_first`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .durable import durable
from .simhash import components, fingerprint_column, first_rows, with_owner
from .simhash import links as fingerprint_links

WORDS, SEED, BANDS, ROWS = 5, 42, 48, 6
#: The least similarity as a fraction, so that the comparison is in whole numbers.
LEAST = (4, 5)
#: Shingles of the texts of one block, what a text counts beside its own, and columns of one matrix product.
BLOCK, EACH, WIDTH = 1 << 16, 64, 1 << 12

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= k:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        low = np.minimum(low, (short[at : at + 512] * _TIMES + _PLUS).min(axis=1))
    raw, width = low.astype("<u4").tobytes(), 4 * ROWS
    return [xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) - (1 << 63) for b in range(BANDS)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough; texts without words are alike."""
    low, high = sorted((len(a), len(b)))
    if LEAST[1] * low < LEAST[0] * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def alike_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of `left` and `right` are alike, as a boolean matrix, from products of their incidence matrices."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(seen > 1) - 1  # what only one set has is in no intersection
    kept = seen[column] > 1
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, (low, low + WIDTH))
        has = np.zeros((len(sets), WIDTH), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        both += has[: len(left)] @ has[len(left) :].T
    size = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return LEAST[1] * both >= LEAST[0] * (size - both)


def _sketch(text: Column) -> Column:
    """node (a hash of the set) and bands of each whole text."""

    @F.arrow_udf("struct<node: long, bands: array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        nodes, keys = [], []
        for t in texts.to_pylist():
            h = shingles(t)
            nodes.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED) - (1 << 63))
            keys.append(bands(h))
        linear.release()  # the worker is idle while joins follow
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "bands"])

    return sketch(text)


def _set(text: Column) -> Column:
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        sets = pa.array([shingles(t).astype("<u8").tobytes() for t in texts.to_pylist()], pa.binary())
        linear.release()
        return sets

    return packed(text)


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of `pairs` (u, v) whose sets are alike."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([alike(x, y) for x, y in zip(_unpacked(a), _unpacked(b), strict=True)], pa.bool_())

    x = sets.select(F.col("node").alias("u"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("set").alias("y"))
    return durable(pairs.join(x, "u").join(y, "v").where(near(F.col("x"), F.col("y"))).select("u", "v"))


def _block_links(table: pa.Table) -> pa.Table:
    """Links (u, v) between the two blocks of a group (or inside the one), for pairs of different roots that have no earlier bucket in common."""
    own = np.array(table.column("own").to_pylist())
    first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    node, root, sets = table.column("node").to_numpy(), table.column("root").to_numpy(), _unpacked(table.column("set"))
    keys = np.array(table.column("bands").to_pylist(), np.int64)
    a, b = np.flatnonzero(own == first), np.flatnonzero(own == second)
    met = alike_pairs([sets[x] for x in a], [sets[x] for x in b]) & (root[a][:, None] != root[b][None, :])
    if first == second:
        met = np.triu(met, 1)
    x, y = np.nonzero(met)
    x, y = a[x], b[y]
    at = table.column("band")[0].as_py()
    new = ~(keys[x, :at] == keys[y, :at]).any(axis=1)
    # one link for each node and root that it meets is enough for components
    u, v = node[x[new]], node[y[new]]
    _, keep = np.unique(np.stack([u, root[y[new]]]), axis=1, return_index=True)
    return pa.table({"u": pa.array(u[keep], pa.int64()), "v": pa.array(v[keep], pa.int64())})


def _compared(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside buckets (band, k) of nodes with their root and size; their bands and sets are fetched for each block."""
    total = open_.groupBy("band", "k").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))  # sizes only, summed before they are shuffled
    blocks = open_.join(total, ["band", "k"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = blocks.withColumn("other", other).select("band", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    return durable(dealt.join(sets, "node").groupBy("band", "k", "i", "j").applyInArrow(_block_links, "u long, v long"))


def _fingerprint_ties(rows: DataFrame) -> DataFrame:
    """Links (u, v) that connect nodes exactly as their texts' SimHash fingerprints within 2 bits do; a fingerprint stands as its smallest node, to which its others are tied."""
    seen = rows.select("node", "fp").distinct()
    prints = durable(seen.groupBy("fp").agg(F.min("node").alias("lead")))
    end = lambda c: prints.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    pairs = fingerprint_links(prints.select("fp")).join(end("u"), "u").join(end("v"), "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    own = with_owner(seen, "fp", prints.select(F.col("fp").alias("__key"), "lead"), "inner").where("lead <> node").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    return pairs.unionByName(own)


def grouped(documents: DataFrame, fingerprints: bool = False) -> DataFrame:
    """doc_id, th (hash of the text) and root (the group's smallest node) of every row. With `fingerprints`, texts whose SimHash fingerprints are within 2 bits are linked too."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    own = {"fp": fingerprint_column(F.col("text"))} if fingerprints else {}
    rows = durable(docs.withColumns({"s": _sketch(F.col("text")), **own}).select("doc_id", "th", "s.node", "s.bands", *own))
    nodes = rows.groupBy("node").agg(F.min(F.struct("th", "bands")).alias("s")).select("node", "s.th", "s.bands")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "k"))
    crowds = keys.groupBy("band", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = durable(keys.join(crowds, ["band", "k"]))
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    leads = met.join(weight, "node").groupBy("band", "k").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"), F.col("node").alias("lead")))["lead"].alias("lead"))
    shared = durable(met.join(leads, ["band", "k"]).select("band", "k", "node", "lead", "n"))
    wanted = shared.select("node").distinct().join(nodes, "node").select("node", "th", "bands")
    sets = durable(docs.select("th", "text").join(wanted, "th").dropDuplicates(["node"]).select("node", "bands", _set(F.col("text")).alias("set")))
    links = _verified(shared.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), sets.select("node", "set"))
    if fingerprints:
        links = durable(links.unionByName(_fingerprint_ties(rows)))
    roots = components(links)
    named = shared.where("n > 2 and node <> lead").join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("band", "k", "node", F.coalesce("root", "node").alias("root"))
    parts = named.groupBy("band", "k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "k")
    open_ = durable(named.join(parts, ["band", "k"]))
    if not open_.isEmpty():
        size = sets.select("node", (F.octet_length("set") / 8 + EACH).alias("size"))
        roots = components(links.unionByName(_compared(open_.join(size, "node"), sets)))
    return with_owner(rows.select("doc_id", "th", "node"), "node", roots.select(F.col("node").alias("__key"), "root")).select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def keep_first(documents: DataFrame, fingerprints: bool = False) -> DataFrame:
    """One row of each group, all columns as they are: the one with the smallest doc_id (null ids last, then by a hash of the text)."""
    return first_rows(documents, grouped(documents, fingerprints))
