"""SimHash against brute force over all pairs."""

import random

import pytest
import xxhash

from quillgraph.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(nodes, near):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_native_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    text = "tiny ünïcode text"
    got = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO", "a b c", "a b c d a b c d", "É é\x0bx\x1cy z", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == slow_print(text)


@pytest.mark.parametrize(("cap", "seed", "distance", "block"), [(2, 1, 2, 1024), (64, 1, 2, 1024), (2, 2, 2, 1024), (64, 2, 2, 1024), (2, 1, 1, 8), (2, 2, 0, 8), (2, 1, 3, 8), (64, 2, 3, 1024)])
def test_links_against_all_pairs(spark, monkeypatch, cap, seed, distance, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(seed)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.choice((1, 2, 40))):
            prints.add(x)
            x ^= 1 << r.randrange(64) if r.random() < 0.5 else 1 << r.randrange(6)
            if r.random() < 0.4:
                x ^= 1 << r.randrange(64)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    own = slow_components(prints, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= distance)
    want = {p: prints[o] for p, o in zip(prints, own, strict=True)}
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance, cap))
    roots = {row["node"]: row["root"] for row in found.collect()}
    assert {p: roots.get(p, p) for p in prints} == want


def test_near_duplicates_and_keep_first(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocab, k=300)) for _ in range(12)]
    near = [t + " tail" for t in texts[:6]]
    rows = [(10 + i, t, "x") for i, t in enumerate(texts + near + texts[:3])] + [(1, None, "n"), (2, "", None), (2, "", None), (None, texts[0], "q"), (None, None, "q"), (None, "lonely unseen words stand here", "q"), (None, "lonely unseen words stand here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(df).collect()), key=repr)
    prints = [slow_print(t) for _, t, _ in rows]
    own = slow_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    low = {}
    for (i, _, _), o in zip(rows, own, strict=True):
        low[o] = min((x for x in (low.get(o), i) if x is not None), default=None)
    assert got == sorted(((i, f"{p:016x}", low[o]) for (i, _, _), p, o in zip(rows, prints, own, strict=True)), key=repr)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert len(ids) == len(set(own)) and sorted(i for i in ids if i is not None) == sorted(v for v in low.values() if v is not None)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_thresholds_cover_the_distance():
    import numpy as np

    both = np.outer(np.full(64, 30.0), np.full(64, 1.0))
    np.fill_diagonal(both, 50)
    for n in (100, 10**6, 10**9, 10**12):
        masks = simhash.plan_masks(n, both)
        r = random.Random(n)
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(range(64), 2))
            assert any(m & diff == 0 for m in masks)


def test_hot_fingerprints_are_looked_up_by_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one text that is copied all over again and again") for i in range(9)] + [(20, "another text of its own"), (21, "another text of its own")], "doc_id long, text string")
    want = sorted(simhash.near_duplicates(df).collect())
    monkeypatch.setattr(simhash, "HOT", 3)
    assert sorted(simhash.near_duplicates(df).collect()) == want
    monkeypatch.setattr(simhash, "MOST_SENT", 0)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == [0, 20]


def test_correlated_bits_are_not_taken_for_independent():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.repeat(r.random((4000, 16)) < 0.5, 4, axis=1)  # every bit stands four times
    both = (x.T.astype(float) @ x).round()
    got = simhash.within(len(x), both, list(range(16)), 2)
    y = x[r.permutation(len(x))][:, :16] != x[:, :16]
    want = [(y.sum(axis=1) <= t).mean() for t in range(3)]
    assert all(0.2 * w < g < 5 * w for g, w in zip(got, want, strict=True)), (got, want)
