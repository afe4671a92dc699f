"""Benchmark decontamination by spaced-seed hashing.

A text is a sequence of lower-cased words (letters, digits, non-ASCII). Fixed
masks pick token positions of a window and ignore the others; hashes of the
picked tokens of every window of every text are looked up among those of the
benchmark's items. Around each hit the item is laid along the text without
gaps, and the pair counts as an overlap if some window of ``WINDOW`` item
words agrees in all but ``WINDOW // 5`` places. The masks are such that every
window with two substitutions still has a hit (a test tries all of them).

An item of n < ``WINDOW`` words is its own window and may differ in n // 5
places; its masks leave out groups of positions, so that some mask avoids any
such substitutions. Items of every length are looked for. `keep_clean` drops a
text only for items of at least ``EVIDENCE`` words: shorter ones are ordinary
phrases.

Null texts have no words and no overlap; null items and items without words
have none either. Items that repeat a text each report their overlaps, and so
do repeated documents; texts of any length are read whole. An empty table on
either side gives an empty result. Columns of any name are kept by
`keep_clean`; `contaminated` keeps none but the id.

The items' index is broadcast, so its size is bounded: items are dealt to as
many blocks as keep each below ``BLOCK_BYTES`` of text, and the corpus is
scanned once for each block. A hash that many items share is expanded in
steps of at most ``STEP`` hits.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .names import spare

WINDOW, EVIDENCE, BLOCK_BYTES, STEP = 13, 5, 8 << 20, 1 << 20
#: Token offsets that each mask looks at.
MASKS = [(0, 1, 4, 5, 8, 9), (0, 1, 2, 3, 5, 6), (0, 3, 4, 7, 9, 10), (0, 1, 5, 7, 8, 10)]
HIT = "array<struct<item_id:bigint,doc_start:int,doc_end:int,matched:int,compared:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("matched", pa.int32()), ("compared", pa.int32())]))
_FILTER_BITS = 20


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of n words such that any n // 5 substitutions avoid one of them."""
    wrong = n // 5
    if not wrong:
        return [tuple(range(n))]
    parts = [list(range(g, n, wrong + 2)) for g in range(wrong + 2)]
    return [tuple(sorted(set(range(n)).difference(*left_out))) for left_out in combinations(parts, wrong)]


class Index:
    """Spaced-seed hashes of one block of items, and the items' words for verification."""

    def __init__(self, ids: list[int], texts: list[str], least: int = 1):
        data, offsets = textvec.utf8(pa.array(texts, pa.large_string()))
        doc, word, _, _ = textvec.tokens(data, offsets, textvec.ALNUM)
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.ids = np.array(ids, np.int64)
        self.words = [word[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.short = sorted({len(w) for w in self.words if least <= len(w) < WINDOW})
        lengths = np.diff(bounds)
        hashes, items, places = [], [], []
        for seed, (mask, size) in enumerate(self.seeds()):
            at, h = _spaced(doc, word, mask, seed)
            own = doc[at]
            ok = (lengths[own] == size) & (at == bounds[own] + mask[0]) if size else lengths[own] >= WINDOW
            hashes.append(h[ok])
            items.append(own[ok])
            places.append((at - bounds[own])[ok])
        h, i, p = np.concatenate(hashes), np.concatenate(items), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], i[order].astype(np.int32), p[order].astype(np.int32)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hash & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def seeds(self):
        """(mask, length of the items that it is for, or 0: all of at least WINDOW words)."""
        return [(m, 0) for m in MASKS] + [(m, n) for n in self.short for m in short_masks(n)]

    def overlaps(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """The overlaps of each text: one for each item, the leftmost of the longest."""
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        doc, word, _, _ = textvec.tokens(data, offsets, textvec.ALNUM)
        if not len(doc) or not len(self.hash):
            return out
        low = np.uint64((1 << _FILTER_BITS) - 1)
        best: dict[tuple[int, int], tuple] = {}
        for seed, (mask, _) in enumerate(self.seeds()):
            at, h = _spaced(doc, word, mask, seed)
            some = self.filter[(h & low).astype(np.int64)]
            at, h = at[some], h[some]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            met = np.flatnonzero(hi > lo)
            at, lo, n = at[met], lo[met], (hi - lo)[met]
            for a, b in _steps(n):
                m = n[a:b]
                flat = np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                place = np.repeat(at[a:b], m)
                self._best(np.unique(np.stack([self.item[flat], place - self.place[flat], doc[place]]), axis=1), doc, word, best)
        for (own, item), (m, _, s, e) in sorted(best.items()):
            out[own].append({"item_id": int(self.ids[item]), "doc_start": s, "doc_end": e, "matched": m, "compared": e - s})
        return out

    def _best(self, cands: np.ndarray, doc: np.ndarray, word: np.ndarray, best: dict) -> None:
        """Puts the longest overlap of each text and item, of equal ones the leftmost, into `best`."""
        for item, start, own in self._verified(cands, doc, word):
            first = int(np.searchsorted(doc, own))
            for s, e, m in start:
                hit = (m, -(s - first), s - first, e - first)
                if hit > best.get((own, item), (-1,)):
                    best[own, item] = hit

    def _verified(self, cands: np.ndarray, doc: np.ndarray, word: np.ndarray):
        """(item, overlaps along one diagonal, text) of the candidates (item, place of the item's first word, text) that hold."""
        splits = np.flatnonzero(np.append(True, cands[0, 1:] != cands[0, :-1]))
        for a, b in zip(splits, np.append(splits[1:], cands.shape[1]), strict=True):
            item = int(cands[0, a])
            words = self.words[item]
            size = len(words)
            window = min(WINDOW, size)
            need = window - window // 5
            for lo in range(a, b, max(1, (1 << 20) // size)):
                part = cands[:, lo : min(b, lo + max(1, (1 << 20) // size))]
                at = part[1][:, None] + np.arange(size)
                inside = (at >= 0) & (at < len(doc))
                at = np.where(inside, at, 0)
                inside &= doc[at] == part[2][:, None]
                same = inside & (word[at] == words)
                sums, room = (np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1) for x in (same, inside))
                good = (sums[:, window:] - sums[:, :-window] >= need) & (room[:, window:] - room[:, :-window] == window)
                for r in np.flatnonzero(good.any(axis=1)):
                    cover = np.zeros(size, bool)
                    for w in np.flatnonzero(good[r]):
                        cover[w : w + window] = True
                    hits = np.flatnonzero(cover & same[r])
                    s, e = int(hits[0]), int(hits[-1]) + 1
                    yield item, [(int(part[1][r]) + s, int(part[1][r]) + e, len(hits))], int(part[2][r])


def _steps(n: np.ndarray):
    """Ranges of positions with at most STEP hits together, or one position."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(int(np.searchsorted(ends, ends[lo] - n[lo] + STEP, side="right")), lo + 1)
        yield lo, hi
        lo = hi


def _spaced(doc: np.ndarray, word: np.ndarray, mask: tuple[int, ...], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first token, hash of the picked tokens) of each window inside one text."""
    mask = tuple(d - mask[0] for d in mask)
    n = len(doc) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[mask[-1] :])
    _, h = textvec.gram(doc, [(word, d) for d in mask], 100 + seed)
    return at, h


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = 1):
    """An Index for each block of items, looking for those of at least `least` words; no block's text is much over `block_bytes`."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        order = np.lexsort([np.array(own.column("text").to_pylist(), object).astype(str), own.column("item_id").fill_null(-1).to_numpy()]) if own.num_rows else []
        ids, texts = own.column("item_id").to_pylist(), own.column("text").to_pylist()
        yield Index([-1 if ids[i] is None else ids[i] for i in order], [texts[i] for i in order], least)


def overlap_column(spark: SparkSession, index: Index, text: Column) -> Column:
    """Array of overlaps of each whole text with the items of one index."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(HIT)
    def overlaps(texts: pa.Array) -> pa.Array:
        data, offsets = textvec.utf8(texts)
        out: list[list[dict]] = []
        for lo, hi in textvec.groups(offsets):
            out += shared.value.overlaps(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        return pa.array(out, _HIT)

    return overlaps(text)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, doc_start, doc_end (words of the text), matched and compared of the longest overlap of each text and item that have one."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    scans = [rows.select("doc_id", F.explode(overlap_column(documents.sparkSession, index, F.col("_text"))).alias("h")).select("doc_id", "h.*") for index in indexes(benchmark)]
    return reduce(DataFrame.unionByName, scans)


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns as they are, that overlap no item of at least EVIDENCE words."""
    (name,) = spare(documents, "hits")
    for index in indexes(benchmark, least=EVIDENCE):
        documents = documents.withColumn(name, overlap_column(documents.sparkSession, index, F.col("text").cast("string"))).where(F.size(name) == 0).drop(name)
    return documents
