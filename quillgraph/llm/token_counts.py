"""Token counts of whole texts with a public tokenizer, lengths only.

Byte-level BPE splits a text into pre-tokens before it merges bytes, and none
of them holds a white-space run that follows other signs. A text can thus be
cut where a printable ASCII sign is followed by a blank or line feed, and the
counts of its pieces add up; long texts are split there like others. Whether
this holds is read from the tokenizer's file (`cuttable`); texts are encoded
whole where it does not.

Pieces of the texts of about TEXT_BYTES of an Arrow batch are worked on together: short ones are
told apart by a 64-bit hash of their bytes (two of REMEMBERED pieces share one
with a probability of about 1e-7, and then a count), each distinct one that the
worker does not know yet is encoded once, and longer ones are encoded as they come.
Calls to the library take batches of about BATCH_BYTES of UTF-8, whatever the
texts they come from.

Special strings inside a text are handled as the library's default does; they
hold no white space, so no cut falls inside one. Null and empty texts have no
tokens. Repeated rows each have a row; further columns are not kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec

LIMIT = 512
#: Pieces that a worker remembers, the most bytes of one, and UTF-8 bytes of one call to the library.
REMEMBERED, SHORT, BATCH_BYTES = 2_000_000, 64, 1 << 18
#: Short pieces that are looked up together, those of them that are hashed together, and UTF-8 bytes of the texts that are cut together (a larger text is alone).
TOGETHER, HASHED, TEXT_BYTES = 1 << 19, 1 << 14, 1 << 21

_counters: dict[str, Counter] = {}
_PRINTABLE = np.array([0x21 <= b <= 0x7E for b in range(256)])
_BLANK = np.array([b in (0x20, 0x0A) for b in range(256)])
_VALUE = textvec.mix(np.arange(1001, 1257, dtype=np.uint64))
_POWER = np.cumprod(np.full(SHORT + 1, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def cuttable(file: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the library's own pattern, and no special string holds or eats white space."""
    pre = file.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    tight = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in file.get("added_tokens") or [])
    return bool(plain and tight and file.get("normalizer") is None and (file.get("model") or {}).get("type") == "BPE")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin: at each text that is not empty, and before a blank or line feed that follows a printable ASCII sign."""
    found = [offsets[:-1][np.diff(offsets) > 0]]
    for lo in range(1, len(data), textvec.CHUNK):
        part = data[lo - 1 : lo + textvec.CHUNK]
        found.append(np.flatnonzero(_PRINTABLE[part[:-1]] & _BLANK[part[1:]]) + lo)
    starts = np.sort(np.concatenate(found))
    return starts[np.append(True, starts[1:] != starts[:-1])] if len(starts) else starts


def piece_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces, none of them empty."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        terms = _VALUE[data[np.repeat(starts, sizes) + place]] * _POWER[place]
        return textvec.mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64))


def balanced(sizes: np.ndarray, most: int = BATCH_BYTES):
    """Ranges of consecutive pieces of at most `most` bytes together; a larger piece is alone."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo] - sizes[lo]
        hi = max(int(np.searchsorted(ends, before + most, side="right")), lo + 1)
        yield lo, hi
        lo = hi


class Counter:
    """Counts tokens with one tokenizer file (.json or .model); kept by the worker process."""

    def __init__(self, path: str):
        import os

        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut, self._lengths = False, lambda texts: [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cluster runs one task a core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.cut = cuttable(json.loads(tokenizer.to_str()))
            self._lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.known, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _encoded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of byte ranges, in batches balanced by bytes."""
        out = np.zeros(len(starts), np.int64)
        for lo, hi in balanced(sizes):
            out[lo:hi] = self._lengths([data[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(starts[lo:hi].tolist(), sizes[lo:hi].tolist(), strict=True)])
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a batch (UTF-8 bytes and offsets). Memory beside the batch follows TEXT_BYTES or the longest text, not the batch."""
        sums = np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in balanced(np.diff(offsets), TEXT_BYTES):
            first = offsets[lo]
            sums[lo:hi] = self._counted(data[first : offsets[hi]], offsets[lo : hi + 1] - first)
        return sums

    def _counted(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(offsets) - 1, np.int64)
        starts = piece_starts(data, offsets) if self.cut else offsets[:-1][np.diff(offsets) > 0]
        if not len(starts):
            return sums
        sizes = np.diff(np.append(starts, len(data)))
        counts = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(sizes <= SHORT) if self.cut else np.zeros(0, np.int64)
        long = np.setdiff1d(np.arange(len(starts)), short, assume_unique=True)
        counts[long] = self._encoded(data, starts[long], sizes[long])
        for lo in range(0, len(short), TOGETHER):
            own = short[lo : lo + TOGETHER]
            counts[own] = self._remembered(data, starts[own], sizes[own])
        np.add.at(sums, np.searchsorted(offsets, starts, side="right") - 1, counts)
        return sums

    def _remembered(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        keys = np.concatenate([piece_keys(data, starts[lo : lo + HASHED], sizes[lo : lo + HASHED]) for lo in range(0, len(starts), HASHED)])
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), bool)
        inside = slot < len(self.known)
        old[inside] = self.known[slot[inside]] == distinct[inside]
        counts = np.zeros(len(distinct), np.int64)
        counts[old] = self.tokens[slot[old]]
        new = ~old
        counts[new] = self._encoded(data, starts[at[new]], sizes[at[new]])
        if len(self.known) > REMEMBERED:
            self.known, self.tokens = distinct, counts
        else:
            self.known, self.tokens = np.insert(self.known, slot[new], distinct[new]), np.insert(self.tokens, slot[new], counts[new])
        return counts[inverse]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of each text; null counts as empty (0)."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(*textvec.utf8(texts)), pa.int64())

    return count(text)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row. `path`: the tokenizer's file, on every executor."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col("_text"), path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
