"""Source divergence, whitening and byte-level BPE against brute force, with odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import bpe, divergence, whitening

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, documents long, n string"


def audit(rows, least=10, top=10):
    """The audit by loops over all terms and pairs."""
    docs = [((r[1] or "").translate(LOW), r[2] or "", r[3] or "") for r in rows]
    frequency, counts, groups = Counter(), Counter(), {(lang, source) for _, lang, source in docs}
    for text, lang, source in docs:
        found = TERM.findall(text)
        counts.update((lang, source, t) for t in found)
        frequency.update((lang, t) for t in set(found))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), d in frequency.items() if x == lang and d >= least)
        sources = sorted(s for x, s in groups if x == lang)
        share = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, x, t] for x in (sources if s is None else [s])) for t in kept}
            below = sum(n.values()) + 2 * len(kept)
            share[s] = {t: (1 + 10**9 * (n[t] + 2) // below, n[t]) for t in kept}
        for s in sources:
            pairs = [(x, sum(f(share[s][t][0], share[x][t][0]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(share[s][t][0], share[None][t][0])) for t in kept if share[s][t][1] and share[s][t][0] > share[None][t][0]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, i))
    return out


def made(n=400, seed=5):
    rng = np.random.default_rng(seed)
    words = [*[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], "Ärger", "ärger", "日本", "ÉTÉ"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 12))).replace("wa", "WA", int(rng.integers(0, 2)))
        rows.append((i, text, ("en", "de", None)[int(rng.integers(0, 3))], "hot" if rng.random() < 0.4 else f"s{rng.integers(0, 6)}", 7, "x"))
    return [*rows, (None, None, "xx", None, None, None), (5, "1 2 3", "xx", "a", 1, ""), rows[0], rows[0], (9, "only " * 50_000, "en", "long", 1, "")]


@pytest.mark.parametrize("block", [1 << 10, 16 << 20])
def test_audit_equals_loops_over_all_terms_and_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PAIRS", 64)
    rows = made()
    found = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == audit(rows)


def test_audit_without_broadcast_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", -1)
    rows = made(120, 8)
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS)).collect()} == audit(rows)
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_are_whole_however_batches_are_cut():
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, 4]
    batch = pa.record_batch({"k": keys})
    for size in (1, 2, 3, 20):
        tables = list(divergence.whole_runs(iter([batch.slice(i, size) for i in range(0, len(keys), size)]), "k"))
        assert sum((t.column("k").to_pylist() for t in tables), []) == keys
        ends = [t.column("k").to_pylist() for t in tables]
        assert all(a[-1] != b[0] for a, b in zip(ends, ends[1:], strict=False))


VECTORS = "vec_id long, embedding array<float>, label int, v string, part long"


def whitened_by_hand(vectors, components):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, v = values[order], v[:, order]
    return x, centred @ v[:, :components] / np.sqrt(values[:components]), values / values.sum()


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(700, 7)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.3, 0.2]) + 5).astype(np.float32)
    vectors[300:500] = vectors[0]  # a hot vector
    odd = [(1, None, 1, "", 1), (2, [float("nan")] + [0.0] * 6, 1, "", 1), (3, [None] + [0.0] * 6, 1, "", 1), (4, [float("inf")] + [0.0] * 6, 1, "", 1), (5, [1.0], 1, "", 1), (6, [], 1, "", 1)]
    rows = [(10 + i, v.tolist(), None, "x", 0) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5), components=32).collect()
    x, want, explained = whitened_by_hand(vectors, 7)
    assert len(found) == 700 * 7
    got = np.zeros((700, 7))
    sums = x.sum(axis=0)
    for r in found:
        i = r.vec_id - 10
        got[i, r.component - 1] = r.whitened
        assert r.n == 700 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        if r.component == 1:
            assert r.deviation == sum((700 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-8


def test_whitening_of_few_or_equal_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0)] * 3, VECTORS)).collect() == []
    line = [(i, [float(i), 2.0 * i], 0, "", 0) for i in range(8)]
    found = whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()
    assert {r.component for r in found} == {1} and len(found) == 8 and abs(found[0].explained - 1) < 1e-12
    assert len(whitening.whiten(spark.createDataFrame([(i % 3, [float(i), float(i * i % 7)], 0, "", 0) for i in range(9)], VECTORS)).collect()) == 18  # repeated ids


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_jacobi_gives_singular_values_to_full_relative_precision(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    scale = 10.0 ** -np.arange(d).clip(0, 9)
    r = np.linalg.qr(rng.normal(size=(d, d)))[0] @ np.diag(scale) @ q.T if d < 6 else rng.normal(size=(d, d))
    values, v = whitening.jacobi(r)
    assert np.allclose(values, np.linalg.svd(r)[1], rtol=1e-6, atol=0)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-12
    assert np.abs(np.sqrt(((r @ v) ** 2).sum(axis=0)) - values).max() < 1e-12


def test_deviation_is_exact_beyond_double_precision():
    x = np.array([[10**9, 5], [3, -(10**9)]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert whitening._deviation(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert whitening._deviation(np.array([[1 << 50]]), 1 << 20, [0]) == [None]


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tokenizers.PATTERN, tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


TEXTS = ["", None, " ", "\n\n  \n", "a", "Hello  world\n\n\tnew\r\n line ", "don't I'LL we've", "<|endoftext|> x", "日本語 テスト", "é" * 300, "x" * 40_000, "word " * 30_000, "a b  c", "\U0001f600 ok \u0000 nul", "1234 567 ½ ²", "... !!  ??\n", "tab\t tab", " lead", "trail "]


@pytest.mark.parametrize("block", [200, 6 << 20])
def test_ids_equal_the_library_and_decode_to_the_text(spark, monkeypatch, coder, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    path, pattern, plain = coder
    rng = np.random.default_rng(4)
    signs = list("ab Z1.'\n\t é日 !-s") + ["  ", "the ", "'s"]
    texts = TEXTS + ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(300)]
    rows = [(i, t, "b", 1) for i, t in enumerate(texts)] + [(0, "again", "", 0), (None, "no id", "", 0)]
    ids = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, block string, n int").repartition(3), path, pattern)
    found = sorted(((r.doc_id, r.ids, r.text) for r in ids.withColumn("text", bpe.decode(ids["ids"], path)).collect()), key=repr)
    want = sorted(((i, plain.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, _, _ in rows), key=repr)
    assert found == want
    if block > 200:
        for r in bpe.digests(ids, path).where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
            if r.doc_id:
                own = plain.encode_ordinary(texts[r.doc_id] or "")
                assert r.n_tokens == len(own)
                assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
                assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_encoding_nothing_and_another_pattern(spark, coder):
    path, _, plain = coder
    kind = "doc_id long, text string"
    assert bpe.encode(spark.createDataFrame([], kind), path, r"\S+|\s+").collect() == []
    whole = bpe.encode(spark.createDataFrame([(1, "a b  c"), (2, "")], kind), path, r"(?s).{1,4}", cuttable=False).collect()
    assert {r.doc_id: r.ids for r in whole} == {1: [i for w in ("a b ", " c") for i in bpe_ids(path, w)], 2: []}
    assert [r[0] for r in spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decode("ids", path)).collect()] == [None]


def bpe_ids(path, word):
    """Merges by rank, one at a time."""
    ranks = bpe.read_ranks(path)
    parts = [bytes([b]) for b in word.encode()]
    while True:
        best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31])
    assert bpe.unpacked(bpe.packed(numbers)[0]).tolist() == numbers.tolist()
    assert bpe.unpacked(bpe.packed(np.zeros(0, np.int64))[0]).tolist() == []
