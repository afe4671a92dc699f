"""Source divergence audit by sort-based streaming: how the words of each source differ from those of the others of its language.

Tasks turn their texts to records (lang, term, source, document, documents,
occurrences), already summed over the documents of a block, so that a common
word gives a task one record for each source and block and no key is hot.
The records are dealt by (lang, term) and sorted by (lang, term, source,
document). A scan over the run lengths of a sorted partition yields each term's
document frequency and its occurrences by source; only a term's own row a
source is ever held. The kept terms are written once to the shared folder.

A second sorted scan emits, for each run of a term, partial sums for the pairs
of sources that share the term. What a term adds to a pair in which one source
lacks it depends on the count in the other alone, and is added from a histogram
of such values; what it adds where both lack it is a constant. So no pair is
made for a source that a term does not occur in, and all is exact: a share is
1 + floor(10^9 (count + 2) / (N + 2 V)) and a divergence floor((p - q)^2 / (p + q)),
in whole numbers.

Each row of the table counts as a document, repeated rows and ids too. Null
text, lang or source count as ''. Texts of any length are read whole, in blocks.
Ties in a rank go to the smaller item in UTF-8 order. A language without a kept
term gives its pairs with 0; a lone source has no pairs. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .durable import stored

#: A term is kept if it is in so many documents of its language.
LEAST_DOCUMENTS = 10
#: Ranks of terms that are returned.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: UTF-8 bytes of text that a task sums up together, and pairs of rows that it works on at once.
BLOCK, PAIRS = 16 << 20, 1 << 20
#: Sums by source are broadcast up to so many rows (under 16 MB); more are joined by a shuffle.
FEW = 100_000

#: Letters of terms, A-Z as a-z; 0 for all signs that part terms.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

_RECORDS = "lang string, term string, source string, document long, documents long, n long"
_RUNS = "lang string, term string, n_lang long, by_source array<struct<source: string, n: long>>"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, coded term) of each term of the texts, in order."""
    letter = LETTER[data]
    inside = letter != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    start = np.flatnonzero(first)
    rank = np.cumsum(inside) - 1
    bounds = np.append(rank[start], inside.sum()).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(letter[inside]))
    return np.searchsorted(offsets, start, side="right") - 1, flat.dictionary_encode()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each (lang, term, source) of a block of texts."""
    for batch in batches:
        data, offsets = textvec.utf8(batch.column("text"))
        pair = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names: dict = {}
        group = np.array([names.setdefault((p["lang"], p["source"]), len(names)) for p in pair.to_pylist()], np.int64)
        langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        ids = batch.column("doc_id")
        for lo, hi in textvec.groups(offsets, BLOCK):
            doc, coded = _terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(doc):
                continue
            size = np.int64(len(coded.dictionary))
            both = np.sort(doc * size + coded.indices.to_numpy())
            at = _runs(both)
            times = np.diff(np.append(at, len(both)))
            doc, term = both[at] // size, both[at] % size
            key = group[lo + doc] * size + term
            order = np.argsort(key, kind="stable")  # documents stay in order
            key, times, doc = key[order], times[order], doc[order]
            at = _runs(key)
            own = key[at] // size
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(own)), coded.dictionary.take(pa.array(key[at] % size)).cast(pa.string()), sources.take(pa.array(own)), ids.take(pa.array(lo + doc[at])), pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(times, at))],
                names=["lang", "term", "source", "document", "documents", "n"],
            )


def _changes(table: pa.Table, *names: str) -> np.ndarray:
    """Rows that differ from the row before in one of the columns; row 0 is one."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in names:
        column = table.column(name).combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


def whole_runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that no run of equal `names` crosses two tables; what is held beside a batch is one run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.flatnonzero(_changes(pa.Table.from_batches([batch]), *names))
        same = bool(held) and all(held[-1].column(c)[len(held[-1]) - 1] == batch.column(c)[0] for c in names)
        if same and len(new) == 1:
            held.append(batch)
            continue
        head = batch.slice(0, int(new[1]) if same else 0)
        if held:
            yield pa.Table.from_batches([*held, head] if len(head) else held)
        body = batch.slice(len(head), int(new[-1]) - len(head))
        if len(body):
            yield pa.Table.from_batches([body])
        held = [batch.slice(int(new[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def _scan(least: int):
    """Run lengths of sorted records: the terms of at least `least` documents, with their occurrences by source."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "lang", "term"):
            new = _changes(table, "lang", "term")
            one = np.flatnonzero(new | _changes(table, "source"))  # a run of a source
            documents = np.add.reduceat(table.column("documents").to_numpy(), one)
            n = np.add.reduceat(table.column("n").to_numpy(), one)
            first = np.flatnonzero(new[one])  # a run of a term, in runs of sources
            keep = np.add.reduceat(documents, first) >= least
            if not keep.any():
                continue
            size = np.diff(np.append(first, len(one)))
            rows = table.take(pa.array(one[first[keep]]))
            inner = np.repeat(keep, size)
            struct = pa.StructArray.from_arrays([table.column("source").take(pa.array(one[inner])).combine_chunks(), pa.array(n[inner])], ["source", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[keep])).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang").combine_chunks(), rows.column("term").combine_chunks(), pa.array(np.add.reduceat(n, first)[keep]), lists], names=["lang", "term", "n_lang", "by_source"]
            )

    return scan


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n_lang and by_source (source, n) of the terms in at least `least` documents of their language, written to the shared folder."""
    texts = documents.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("doc_id").cast("long").alias("doc_id")
    )
    dealt = texts.mapInArrow(_records, _RECORDS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return stored(dealt.mapInArrow(_scan(least), _RUNS))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); all are whole numbers."""
    big = [x.cast("decimal(19,0)") for x in (n, total, terms)]
    above = (big[0] + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = F.greatest(big[1] + big[2] * F.lit(2).cast("decimal(1,0)"), F.lit(1).cast("decimal(21,0)"))
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums over the runs of a sorted partition: what each term adds to the pairs of sources that both have it, beyond what it adds if one lacks it."""

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for table in whole_runs(batches, "lang", "term"):
        first = np.flatnonzero(_changes(table, "lang", "term"))
        p, z = table.column("p").to_numpy(), table.column("z").to_numpy()
        names: dict = {}
        code = np.array([names.setdefault(x, len(names)) for x in zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True)], np.int64)
        end = np.repeat(np.append(first[1:], len(p)), np.diff(np.append(first, len(p))))
        partners = end - np.arange(len(p)) - 1
        upto = np.cumsum(partners)
        sums: dict[int, int] = {}
        lo = 0
        while lo < len(p):
            hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")), lo + 1)
            k = partners[lo:hi]
            a = np.repeat(np.arange(lo, hi), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            value = f(p[a], p[b]) - f(p[a], z[b]) - f(z[a], p[b]) + f(z[a], z[b])
            key = code[a] << 32 | code[b]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            at = _runs(key)
            if len(at):
                for x, v in zip(key[at].tolist(), np.add.reduceat(value, at).tolist(), strict=True):
                    sums[x] = sums.get(x, 0) + v
            lo = hi
        if sums:
            named = list(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([named[x >> 32][0] for x in sums], pa.string()), pa.array([named[x >> 32][1] for x in sums], pa.string()), pa.array([named[x & 0xFFFFFFFF][1] for x in sums], pa.string()), pa.array(list(sums.values()), pa.int64())],
                names=["lang", "source", "item", "value"],
            )


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of every occurring (lang, source)."""
    kept = kept_terms(documents, least)
    rows = kept.select("lang", "term", "n_lang", F.inline("by_source"))
    groups = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    counted = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    totals = stored(counted.fillna(0, ["total", "v", "total_lang"]).withColumn("z", share(F.lit(0), F.col("total"), F.col("v"))))
    small = F.broadcast if totals.count() <= FEW else (lambda df: df)

    shares = rows.join(small(totals), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    lang_share = share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    best = shares.withColumn("q", lang_share).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    others = totals.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"))
    base = totals.join(others, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * divergence(F.col("z"), F.col("z_item"))).alias("value"))
    lone = (
        shares.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("k")).join(small(others), "lang").where("source <> item")
        .groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (divergence(F.col("p"), F.col("z_item")) - divergence(F.col("z"), F.col("z_item")))).alias("value"))
    )
    both = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_shared_pairs, "lang string, source string, item string, value long")
    half = lone.unionByName(both)
    mirrored = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(half).unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
