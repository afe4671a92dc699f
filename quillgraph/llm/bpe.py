"""Byte-level BPE by a shuffle of distinct words, and decoding by a join with the token-byte table.

Texts go to blocks of about BLOCK bytes. A block's texts are parted into
pre-tokens, position by position. All of a block is written once to the shared
folder: a row that says which word stands at each position, and a row for each
bucket of distinct words by their hash. The buckets are shuffled, so that equal
words of the whole corpus meet; a task scans one bucket after another, encodes
each distinct word of a bucket once and joins its ids to the blocks' words. As
a block gives each bucket one row, a common word costs no more than others and
no task is hot. A block's rows then meet again, and its texts are reassembled
by position. Rows hold packed and compressed numbers and words, for the volume
of one row a word or a pre-token would be several times the corpus.

Pre-tokens are the matches of a pattern over the whole text. Texts are first
cut where a printable ASCII sign is followed by a blank or line feed: no match
holds a white-space run that follows other signs, so the matches of the parts
are those of the text, and each distinct part of a block is matched once. The
parts are told apart by their bytes, not by a hash. A pattern for which this
does not hold is matched over whole texts (`cuttable=False`).

Null and empty texts have no ids. Each row is encoded, repeated rows and ids
too. A text is never cut over two blocks, so memory follows the longest text. An
empty table gives an empty result; further columns are not kept. A rank file
without all 256 single bytes raises an error where a text needs one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .durable import stored
from .token_counts import piece_starts

#: UTF-8 bytes of the texts of a block. Buckets of words are as many as shuffle partitions, but no fewer than LEAST_BUCKETS; a task of the encoding stage has one at least.
BLOCK, LEAST_BUCKETS = 12 << 20, 64

#: bucket -1: the words at a block's positions, with its documents and their numbers of pre-tokens.
_ROWS = "block long, bucket int, body binary, ids array<long>, sizes array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of 7 bits each, the last one marked by its top bit; (bytes, bytes of each number)."""
    size = np.ones(len(numbers), np.int64)
    for bits in (7, 14, 21, 28):
        size += numbers >= 1 << bits
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[ends[own] - size[own] + k] = numbers[own] >> 7 * k & 127
    out[ends - 1] |= 128
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that `packed` wrote."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data & 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def _words(data: np.ndarray, offsets: np.ndarray, pattern, cuttable: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their codes in order, number of pre-tokens of each text)."""
    starts = piece_starts(data, offsets) if cuttable else offsets[:-1][np.diff(offsets) > 0]
    bounds = np.append(starts, len(data)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    known: dict[str, int] = {}
    flat: list[int] = []
    sizes = np.zeros(len(parts.dictionary), np.int64)
    for i, part in enumerate(parts.dictionary.to_pylist()):
        found = [known.setdefault(w, len(known)) for w in pattern.findall(part)]
        sizes[i] = len(found)
        flat += found
    first = np.cumsum(sizes) - sizes
    which = parts.indices.to_numpy()
    own = sizes[which]
    place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    codes = np.array(flat, np.int64)[np.repeat(first[which], own) + place]
    counts = np.zeros(len(offsets) - 1, np.int64)
    np.add.at(counts, np.searchsorted(offsets, starts, side="right") - 1, own)
    return [w.encode() for w in known], codes, counts


def _sealed(*numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """Lists of whole numbers and further bytes, compressed."""
    parts = [packed(x)[0].tobytes() for x in numbers]
    body = b"".join([*parts, rest])
    head = np.array([len(body), *map(len, parts)], np.int64).tobytes()
    return head + pa.Codec("zstd", compression_level=9).compress(body, asbytes=True)


def _opened(sealed: bytes, lists: int) -> tuple[list[np.ndarray], bytes]:
    size, *lengths = np.frombuffer(sealed, np.int64, lists + 1).tolist()
    body = pa.decompress(sealed[8 * (lists + 1) :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for n in lengths:
        out.append(unpacked(np.frombuffer(body, np.uint8, n, at)))
        at += n
    return out, body[at:]


def _ranks(n: np.ndarray) -> np.ndarray:
    """Place of each word by falling frequency."""
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    return rank


def _planes(ids: np.ndarray) -> bytes:
    """Ids as four planes of bytes: the upper ones are mostly zero and vanish in compression."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def _front(words: list[bytes]) -> bytes:
    """Sorted words, each as the number of bytes that it shares with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for word in words:
        k, most = 0, min(len(word), len(last))
        while k < most and word[k] == last[k]:
            k += 1
        shared.append(k)
        rest.append(word[k:])
        last = word
    return _sealed(np.array(shared), np.array([len(x) for x in rest]), rest=b"".join(rest))


def _exploded(pattern: str, cuttable: bool, buckets: int):
    """Blocks of texts to a row with the positions of each distinct word, and rows of words by bucket."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            data, offsets = textvec.utf8(batch.column(1))
            for lo, hi in textvec.groups(offsets, BLOCK):
                words, codes, counts = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], compiled, cuttable)
                hashed = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
                by_bucket = np.array(sorted(range(len(words)), key=lambda i: (hashed[i], words[i])), np.int64)  # noqa: B023
                place = np.empty(len(words), np.int64)
                place[by_bucket] = np.arange(len(words))
                codes = place[codes]
                n = np.bincount(codes, minlength=len(words))
                block = uuid4().int >> 65
                rows = [(-1, _sealed(n, _ranks(n)[codes]))]  # frequent words have small numbers
                found, at = np.unique(hashed[by_bucket], return_index=True)
                for bucket, a, z in zip(found.tolist(), at.tolist(), np.append(at, len(words))[1:].tolist(), strict=True):
                    rows.append((bucket, _front([words[i] for i in by_bucket[a:z]])))
                k = len(rows) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * (k + 1), pa.int64()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()] + [None] * k, pa.list_(pa.int64())),
                        pa.array([counts.tolist()] + [None] * k, pa.list_(pa.int32())),
                    ],
                    names=["block", "bucket", "body", "ids", "sizes"],
                )

    return explode


def _encoded(ranks_path: str):
    """Words of sorted buckets to their ids, in the same order: bytes merged by rank, the lowest first."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        one = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        known, now = {}, None
        for batch in batches:
            bodies = []
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                (shared, sizes), flat = _opened(body, 2)
                ends = np.cumsum(sizes).tolist()
                ids: list[int] = []
                lengths, word = [], b""
                for k, a, z in zip(shared.tolist(), [0, *ends], ends, strict=False):
                    word = word[:k] + flat[a:z]
                    own = known.get(word)
                    if own is None:
                        own = known[word] = one(word.decode())
                    ids += own
                    lengths.append(len(own))
                bodies.append(_sealed(np.array(lengths), rest=_planes(np.array(ids))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(bodies, pa.binary())], names=["block", "bucket", "body"])

    return encode


def _reassembled(block: pa.Table) -> pa.Table:
    """Ids of the documents of a block: each word's ids stand at its positions."""
    rows = sorted(zip(block.column("bucket").to_pylist(), block.column("body").to_pylist(), range(len(block)), strict=True))
    documents, sizes = (block.column(c)[rows[0][2]].values for c in ("ids", "sizes"))
    (n, seen), _ = _opened(rows[0][1], 2)
    upto = np.zeros(len(documents) + 1, np.int64)
    tokens = np.zeros(0, np.int32)
    if len(n):
        parts = [_opened(body, 1) for _, body, _ in rows[1:]]
        lengths = np.concatenate([p[0][0] for p in parts])
        if len(lengths) != len(n):
            raise ValueError("words of a block are missing")
        flat = np.concatenate([_from_planes(p[1]) for p in parts])
        begin = np.cumsum(lengths) - lengths
        word = np.argsort(-n, kind="stable")[seen]
        own = lengths[word]
        ends = np.cumsum(own)
        tokens = flat[np.repeat(begin[word] - (ends - own), own) + np.arange(int(ends[-1]))]
        upto = np.append(0, ends)[np.append(0, np.cumsum(sizes.to_numpy()))]
    return pa.table({"doc_id": documents, "ids": pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(tokens, pa.int32()))})


def encode(documents: DataFrame, ranks_path: str, pattern: str, cuttable: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row, as a byte-pair encoding by the ranks of `ranks_path` gives them without special tokens."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(LEAST_BUCKETS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(texts.mapInArrow(_exploded(pattern, cuttable, buckets), _ROWS))
    words = rows.where("bucket >= 0").select("block", "bucket", "body").repartition("bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encoded(ranks_path), "block long, bucket int, body binary")
    met = rows.where("bucket < 0").unionByName(ids, allowMissingColumns=True)
    return met.groupBy("block").applyInArrow(_reassembled, "doc_id long, ids array<int>")


def decode(ids: Column, ranks_path: str) -> Column:
    """Bytes of each list of ids; null lists stay null. The token-byte table is the rank file: a bounded table that each task joins by id."""
    kept: dict = {}

    @F.arrow_udf("binary")
    def join(lists: pa.Array) -> pa.Array:
        if not kept:
            ranks = read_ranks(ranks_path)
            table: list = [None] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            kept["table"] = pa.array(table, pa.large_binary())
        tokens = kept["table"].take(lists.flatten())
        if tokens.null_count:
            raise ValueError("an id is not in the rank file")
        counts = lists.value_lengths().fill_null(0).to_numpy()
        _, ends, data = tokens.buffers()
        upto = np.frombuffer(ends, np.int64, len(tokens) + 1, tokens.offset * 8) if len(tokens) else np.zeros(1, np.int64)
        bounds = upto[np.append(0, np.cumsum(counts))]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(bounds)), data])
        return pc.if_else(lists.is_valid(), whole, None).cast(pa.binary())  # the tokens' bytes lie one after another

    return join(ids)


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the bytes that they decode to."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks_path), 256).alias("decoded_sha256")
    )
