"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is set if it is set in over half the XXH64 hashes of a
text's word shingles. Fingerprints within `distance` bits link; a component
is everything reachable by links.

Search: bits that go together are grouped into partitions, and thresholds
t_i >= -1 with sum(t_i + 1) = distance + 1 are dealt to them: two
fingerprints within `distance` bits must be within t_i bits on some
partition i. Dynamic programming picks the thresholds (and the number of
partitions) with the least cost, estimated from how often all fingerprints
have each bit and each two bits: keys made plus candidates to verify. A
partition with threshold t makes a key for each choice of t of its bits to
ignore; equal keys are candidates, and each pair is verified on all bits.

A bucket of more than `cap` fingerprints makes no pairs. At a distance of 2
its members link exactly by another way: two fingerprints within 2 bits share
a point at most one bit from each, and for members of one bucket that bit is
one in which the bucket's members differ; a point has at most 65 fingerprints
near it, which all link. At other distances the bucket is dealt to blocks of
about BLOCK, and a task compares two of them.

Work is on distinct fingerprints, so copies, however many, cost one row.
Links become components by alternating star contractions; every round is
written to the shared checkpoint folder.

Null texts are empty: they have no word and fingerprint zero. Rows whose
doc_id is null link like others but never name a component; a component of
such rows only has a null id. Repeated ids are rows of their own.
"""

from __future__ import annotations

from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .names import spare

SHINGLE, DISTANCE, SEED, CAP = 3, 2, 42, 64
#: Rows of a fingerprint that make it a hot key, and keys of dropped rows that are broadcast.
HOT, MOST_SENT = 100_000, 1 << 20
#: Fingerprints of a block of a crowded bucket.
BLOCK = 1024


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """64-bit SimHash as an unsigned number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= k:
        return _majority(np.array([digest(line, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return _majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, k: int = SHINGLE) -> Column:
    """Signed 64-bit fingerprint of each whole text."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t or "", k) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return prints(text)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Count of all fingerprints, and the 64 x 64 table of how many have both bits (the diagonal: each bit)."""

    def both(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch.column(0).to_numpy()
            for lo in range(0, len(values), 1 << 15):
                x = np.unpackbits(values[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["cell", "n"])

    cells = prints.select("fp").mapInArrow(both, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 4097 rows
    flat = np.zeros(4097)
    flat[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near equal size, each grown from a bit by its strongest mean correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = set(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        start = max(left, key=lambda b: (related[b, sorted(left)].sum(), -b))
        group = [start]
        left.remove(start)
        while len(group) < size:
            nxt = max(left, key=lambda b: (related[b, group].mean(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of fingerprint pairs that differ in at most 0 .. `most` of `bits`.

    Mean and variance of the count of differing bits follow from how often all
    fingerprints have each bit and each two bits; a beta-binomial law with
    both is taken, so that bits that go together are not counted as independent.
    """
    size = len(bits)
    one = np.diag(both)[bits] / max(n, 1)
    p11 = both[np.ix_(bits, bits)] / max(n, 1)
    p10 = np.maximum(one[:, None] - p11, 0)
    p00 = np.maximum(1 - one[:, None] - one[None, :] + p11, 0)
    joint = 2 * (p11 * p00 + p10 * p10.T)  # both bits differ in a pair
    d = 2 * one * (1 - one)
    np.fill_diagonal(joint, d)
    mean = float(np.clip(d.mean(), 1e-6, 1 - 1e-6))
    spread = max(float((joint - np.outer(d, d)).sum()), 0.0) / (size * mean * (1 - mean))
    rho = float(np.clip((spread - 1) / (size - 1), 1e-6, 0.999)) if size > 1 else 1e-6
    a, b = mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)
    mass = [exp(lgamma(size + 1) - lgamma(x + 1) - lgamma(size - x + 1) + lgamma(x + a) + lgamma(size - x + b) - lgamma(size + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)) for x in range(most + 1)]
    return np.cumsum(mass)


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """(cost, thresholds) of the cheapest thresholds of at least -1 whose sum with the number of groups is distance + 1."""
    units = distance + 1
    cost = np.full((len(groups), units + 1), np.inf)
    for g, bits in enumerate(groups):
        most = min(distance, len(bits))
        near = within(n, both, bits, most)
        cost[g, 0] = 0
        for t in range(most + 1):
            cost[g, t + 1] = n * comb(len(bits), t) + 0.5 * n * n * near[t] * comb(len(bits), t) ** 0.5
    best = {0: (0.0, [])}
    for g in range(len(groups)):
        best = {u: min((c + cost[g, x], [*ts, x - 1]) for v, (c, ts) in best.items() for x in [u - v] if 0 <= x) for u in range(units + 1) if any(v <= u for v in best)}
    return best[units]


def plan_masks(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[int]:
    """Signed masks of the bits that keys keep, for the cheapest number of groups and their thresholds."""
    from itertools import combinations

    plans = []
    for parts in range(1, distance + 3):
        groups = correlated_groups(n, both, parts)
        cost, thresholds = allocate(n, both, groups, distance)
        plans.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(plans, key=lambda x: x[:2])
    masks = []
    for bits, t in zip(groups, thresholds, strict=True):
        for ignored in combinations(bits, t) if t >= 0 else ():
            mask = sum(1 << b for b in bits if b not in ignored)
            masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def _block_stars(distance: int):
    """Ties of two blocks' fingerprints within `distance` bits: each to the smallest of its connected part."""

    def ties(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        bits = fp.view(np.uint64)
        near = np.zeros((len(fp), len(fp)), bool)
        for r in range(len(fp)):
            near[r] = np.bitwise_count(bits ^ bits[r]) <= distance
        low = np.arange(len(fp))
        while True:
            new = np.where(near, low[None, :], len(fp)).min(axis=1)
            if (new == low).all():
                break
            low = new
        some = low < np.arange(len(fp))
        return pa.table({"u": pa.array(fp[low[some]], pa.int64()), "v": pa.array(fp[some], pa.int64())})

    return ties


def links(prints: DataFrame, distance: int = DISTANCE, cap: int = CAP) -> DataFrame:
    """(u, v): pairs that connect exactly the distinct fingerprints `fp` that links of `distance` or fewer bits connect."""
    masks = plan_masks(*bit_statistics(prints), distance)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.m", "s.k")
    buckets = keyed.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("vary")).where("n > 1")
    shared = keyed.join(buckets, ["m", "k"])
    small = shared.where(F.col("n") <= cap).select("m", "k", "fp")
    pairs = small.alias("a").join(small.alias("b"), ["m", "k"]).where(F.expr(f"a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {int(distance)}")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if distance != 2:
        blocks = F.ceil(F.col("n") / BLOCK)
        dealt = shared.where(F.col("n") > cap).select("m", "k", "fp", F.pmod(F.xxhash64("fp"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        return pairs.unionByName(dealt.groupBy("m", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).applyInArrow(_block_stars(distance), "u long, v long")).distinct()
    crowded = shared.where(F.col("n") > cap).groupBy("fp").agg(F.bit_or("vary").alias("vary"))
    points = "concat(array(fp), transform(filter(sequence(0, 63), j -> (shiftrightunsigned(vary, j) & 1L) = 1L), j -> fp ^ shiftleft(1L, j)))"
    near = crowded.select("fp", F.explode(F.expr(points)).alias("z"))
    stars = near.withColumn("u", F.min("fp").over(Window.partitionBy("z"))).where("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of `edges` (u, v) the smallest node of its component."""
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        # large star: every larger neighbour is tied to the smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node ties its smaller neighbours, and itself, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_owner(rows: DataFrame, key: str, owner: DataFrame, how: str = "left") -> DataFrame:
    """`rows` with the columns of `owner`, which has one row a `__key`. Keys of over HOT rows, of which there are at most rows / HOT, are looked up by broadcast; the others are joined."""
    hot = durable(rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT).select("__hot"))
    few = F.broadcast(hot)
    known = owner.join(few, F.col("__key") == F.col("__hot"), "left_semi")
    cold = rows.join(few, F.col(key) == F.col("__hot"), "left_anti").join(owner, F.col(key) == F.col("__key"), how)
    crowded = rows.join(few, F.col(key) == F.col("__hot"), "left_semi").join(F.broadcast(known), F.col(key) == F.col("__key"), how)
    return cold.unionByName(crowded).drop("__key")


def _grouped(documents: DataFrame, distance: int, k: int, cap: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text), fp, component_id and root (the component's smallest fingerprint) of every row."""
    text = F.col(text_col).cast("string")
    rows = durable(documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), fingerprint_column(text, k).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    roots = components(links(prints.select("fp"), distance, cap))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("lead").alias("component_id"))
    owner = durable(named.select(F.col("fp").alias("__key"), "root").join(ids, "root"))
    return with_owner(rows, "fp", owner, "inner").select("doc_id", "th", "fp", "component_id", "root")


def _hex(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, k: int = SHINGLE, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row; further columns are not kept."""
    return _grouped(documents, distance, k, cap, id_col, text_col).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, distance: int = DISTANCE, k: int = SHINGLE, cap: int = CAP) -> DataFrame:
    """One row of each component, all columns as they are: the one with the smallest doc_id (null ids last, then by a hash of the text)."""
    return first_rows(documents, _grouped(documents, distance, k, cap, "doc_id", "text"))


def first_rows(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The first row of each root of `rows` (doc_id, th, root), which `documents` were grouped to.

    Which rows go is found out on ids and hashes. Up to MOST_SENT of them are broadcast, so that the texts stay
    where they are; more are joined. Rows that repeat both id and text are found again by their keys.
    """
    z, i, h, r = spare(documents, "z", "i", "h", "r")
    own = {z: F.col("doc_id").isNull(), i: F.coalesce("doc_id", F.lit(0)), h: F.col("th")}
    keys = durable(rows.withColumns(own).groupBy(z, i, h).agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n")))
    first = keys.groupBy("root").agg(F.min(F.struct(z, i, h)).alias("s")).select("s.*")
    gone = durable(keys.join(first, [z, i, h], "left_anti").select(z, i, h))
    again = durable(keys.where("n > 1").join(first, [z, i, h], "left_semi").select(z, i, h))
    sent = lambda t: F.broadcast(t) if t.count() <= MOST_SENT else t
    marked = documents.withColumns({z: own[z], i: own[i], h: F.xxhash64(F.col("text").cast("string"))})
    kept = marked.join(sent(gone), [z, i, h], "left_anti")
    if not again.isEmpty():
        twice = sent(again)
        number = F.row_number().over(Window.partitionBy(z, i, h).orderBy(F.lit(1)))
        one = kept.join(twice, [z, i, h], "left_semi").withColumn(r, number).where(F.col(r) == 1).drop(r)
        kept = kept.join(twice, [z, i, h], "left_anti").unionByName(one)
    return kept.select(*documents.columns)
