"""Near copies of the pipeline's stage against brute force over all pairs."""

import random

import corpus_pipeline
from quillgraph.llm import near_copies, simhash


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_near(a, b):
    a, b = slow_set(a), slow_set(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def cases():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (6, 20, 60, 200, 900):
        for _ in range(4):
            base = r.choices(vocab, k=n)
            texts.append(" ".join(base))
            for share in (0.02, 0.04, 0.06):
                edited = list(base)
                for i in r.sample(range(n), max(1, int(share * n / 2))):
                    edited[i] = "new" + r.choice(vocab)
                texts.append(" ".join(edited))
    return [*texts, *texts[:5], "A b", "a  B", "b a", "", None, " \n"]


def test_stage_removes_edited_copies(spark):
    texts = cases()
    r = random.Random(9)
    ids = r.sample(range(1000), len(texts))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if slow_near(texts[i], texts[j]):
                root = [root[j] if x == root[i] else x for x in root]
    want = sorted(min(i for i, o in zip(ids, root, strict=True) if o == k) for k in set(root))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted(x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, df, "").collect())
    assert got == want
    assert len(got) < simhash.keep_first(df).count()


def test_stage_links_fingerprints(spark):
    """Texts within 2 fingerprint bits are one group however few shingles their sets share, and pass that on to what is alike in words."""
    cycle = "one two three four five " * 300
    tails = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    texts = [cycle + tails[0], cycle + tails[1], cycle + tails[1] + " end", "another text of quite other words", None]
    bits = [simhash.fingerprint(t or "") for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 2 and not any(slow_near(texts[0], t) for t in texts[1:]) and slow_near(*texts[1:3])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, df, "").collect()) == [0, 3, 4]
    assert sorted(x["doc_id"] for x in near_copies.keep_first(df).collect()) == [0, 1, 3, 4]


def test_a_bucket_of_two_groups(spark, monkeypatch):
    """With every node in one bucket, pairs that do not touch its smallest node are still linked."""
    monkeypatch.setattr(near_copies, "_sketch", same_bucket())
    texts = ["a b c d e f", "a b c d e f f f f f f", "x y z u v w", *(" ".join(f"{c}{i}" for i in range(40)) + t for c in "pqr" for t in ("", " end", " stop"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in near_copies.keep_first(df).collect()) == [0, 1, 2, 3, 6, 9]


def test_many_blocks_of_one_bucket(spark, monkeypatch):
    """Blocks of a few texts give the groups that one block gives."""
    texts = [t or "" for t in cases()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(x["doc_id"] for x in near_copies.keep_first(df).collect())
    monkeypatch.setattr(near_copies, "_sketch", same_bucket())
    monkeypatch.setattr(near_copies, "BLOCK", 3000)
    assert sorted(x["doc_id"] for x in near_copies.keep_first(df).collect()) == want


def test_matrix_of_similar_pairs():
    import numpy as np

    sets = [near_copies.shingles(t) for t in cases()]
    got = near_copies.alike_pairs(sets[:40], sets[30:])
    assert (got == np.array([[near_copies.alike(a, b) for b in sets[30:]] for a in sets[:40]])).all()


def same_bucket():
    from pyspark.sql import functions as F

    return lambda text: F.struct(F.xxhash64(text).alias("node"), F.array(F.lit(1).cast("long")).alias("bands"))
