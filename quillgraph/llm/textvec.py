"""Vectorised tokenising and n-gram hashing of whole Arrow string columns.

Everything here works on the UTF-8 buffer of a batch with numpy: no Python
object is made per word.  Byte-level work runs over pieces of about
``CHUNK`` bytes cut between tokens, so memory follows the number of tokens of
a batch and not the length of its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_POW_LEN = 1 << 12
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=np.uint64)


_POW = _powers(_POW_LEN)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their low bits can be used as buckets."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def _table(fn) -> np.ndarray:
    return np.array([fn(b) for b in range(256)])


#: ASCII white space separates words; every byte of a multi-byte character belongs to one.
NON_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D)).astype(bool)
#: Letters, digits and all non-ASCII bytes.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum()).astype(bool)
LOWER = _table(lambda b: b + 32 if 65 <= b <= 90 else b).astype(np.uint8)
#: A code for each byte with which words' shapes are built: lower, upper, digit, or the sign itself.
SHAPE = _table(lambda b: 1 if b >= 0x80 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b).astype(np.uint8)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def _cuts(data: np.ndarray, keep: np.ndarray):
    """Ranges of about CHUNK bytes, none of which ends inside a token."""
    pos, n = 0, len(data)
    while pos < n:
        end = min(pos + CHUNK, n)
        while end < n:
            window = keep[data[end : end + 4096]]
            if window.all():
                end += len(window)
            else:
                end += int(np.argmin(window))
                break
        yield pos, min(end, n)
        pos = min(end, n)


def tokens(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, shapes: bool = False, stems: tuple[int, ...] = ()):
    """(document index, hash of the lower-cased token, hash of its shape or None, hashes of its first k bytes for each k of `stems`) of each token in order.

    A token is a maximal run of bytes that `keep` marks; it never crosses two
    texts.  A token of at most k bytes has 0 for a stem.
    """
    docs, words, forms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    heads = [[np.zeros(0, np.uint64)] for _ in stems]
    for lo, hi in _cuts(data, keep):
        part = data[lo:hi]
        inside = keep[part]
        first = np.zeros(hi - lo, bool)
        a, b = np.searchsorted(offsets, (lo, hi))
        edges = offsets[a:b] - lo
        first[edges[edges < hi - lo]] = True
        if lo not in (0, *offsets[a : a + 1]):
            first[0] = True  # a cut stands between tokens
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | first))
        if not len(start):
            continue
        at = np.flatnonzero(inside)
        bounds = np.searchsorted(at, start)
        lengths = np.diff(np.append(bounds, len(at)))
        pos = np.arange(len(at)) - np.repeat(bounds, lengths)
        chars = part[at]
        with np.errstate(over="ignore"):
            terms = _VALUE[LOWER[chars]] * _POW[pos % _POW_LEN]
            words.append(np.add.reduceat(terms, bounds))
            for k, head in zip(stems, heads, strict=True):
                terms[pos >= k] = 0
                head.append(np.where(lengths > k, np.add.reduceat(terms, bounds), np.uint64(0)))
            if shapes:
                kind = SHAPE[chars]
                change = np.empty(len(kind), bool)
                change[0] = True
                change[1:] = kind[1:] != kind[:-1]
                change[bounds] = True
                kept = np.flatnonzero(change)
                kb = np.searchsorted(kept, bounds)
                kpos = np.arange(len(kept)) - np.repeat(kb, np.diff(np.append(kb, len(kept))))
                forms.append(np.add.reduceat(_VALUE[kind[kept]] * _POW[kpos % _POW_LEN], kb))
        docs.append(np.searchsorted(offsets, start + lo, side="right") - 1)
    return np.concatenate(docs), np.concatenate(words), np.concatenate(forms) if shapes else None, [np.concatenate(h) for h in heads]


def gram(doc: np.ndarray, parts: list[tuple[np.ndarray, int]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of token tuples: `parts` are (token hashes, distance from the first token); no tuple crosses two texts."""
    reach = max(d for _, d in parts)
    n = len(doc) - reach
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = doc[:n] == doc[reach:]
    h = np.full(n, np.uint64(seed) * np.uint64(0x9E3779B9) + np.uint64(1), np.uint64)
    with np.errstate(over="ignore"):
        for hashes, d in parts:
            h = mix(h * np.uint64(31) + hashes[d : d + n] + np.uint64(d))
    return doc[:n][ok], h[ok]


def distinct(doc: np.ndarray, bucket: np.ndarray, n_docs: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text in CSR form (indptr, indices)."""
    both = np.sort(doc.astype(np.int64) * dim + bucket.astype(np.int64))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    indptr = np.searchsorted(both, np.arange(n_docs + 1, dtype=np.int64) * dim)
    return indptr, (both % dim).astype(np.int32)


def groups(offsets: np.ndarray, most: int = 2 << 20):
    """Ranges of texts of at most `most` bytes together, a longer text alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
