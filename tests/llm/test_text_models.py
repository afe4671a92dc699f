"""Vectorised tokenising against plain Python, and the classifiers' held-out accuracy and edge cases."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import linear, quality, textvec, toxicity

MIDDLE = "/root/testdata/sf0.1"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Bé\n\t.1", max_size=30), max_size=6), st.integers(2, 40))
def test_tokens_against_split(texts, chunk):
    data, off = textvec.utf8(pa.array(texts, pa.string()))
    old = textvec.CHUNK
    try:
        textvec.CHUNK = chunk  # cuts must not change anything
        doc, word, _, _ = textvec.tokens(data, off, textvec.NON_SPACE)
    finally:
        textvec.CHUNK = old
    want = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
    assert doc.tolist() == [i for i, _ in want]
    same = {}
    for h, (_, w) in zip(word.tolist(), want, strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_grams_stay_inside_a_text():
    data, off = textvec.utf8(pa.array(["a b c", None, "d", "e f"]))
    doc, word, _, _ = textvec.tokens(data, off, textvec.NON_SPACE)
    d, h = textvec.gram(doc, [(word, 0), (word, 1)], 1)
    assert d.tolist() == [0, 0, 3] and len(set(h.tolist())) == 3


def test_fold(spark):
    from pyspark.sql import functions as F

    got = {r["i"]: r["h"] for r in spark.range(50).select(F.col("id").alias("i"), linear.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


@pytest.mark.parametrize("module,label,floor", [(quality, "quality", 0.97), (toxicity, "toxic", 0.96)])
def test_held_out_accuracy(spark, module, label, floor):
    d, lab = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = module.fit(d, lab)
    out = module.classify(d.join(lab, "doc_id", "left_semi"), model).where("held_out").join(lab, "doc_id").toPandas()
    assert (out["predicted"] == out[label]).mean() >= floor
    assert out["score"].between(0, 1).all()
    clean = out[out[label] == (0 if label == "toxic" else 1)]
    assert (clean["predicted"] == clean[label]).mean() >= 0.99


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_change_nothing(spark, module, label):
    d = spark.createDataFrame([(i, f"good words {i} here" if i % 3 else f"bad ### words {i} %%%") for i in range(120)], "doc_id long, text string")
    rows = [(i, int(bool(i % 3)), int(not i % 3)) for i in range(120)]
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in rows]
    scores = []
    for lab in (rows, flipped):
        out = module.classify(d, module.fit(d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int")))
        scores.append({r["doc_id"]: r["score"] for r in out.collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, module, label):
    d = spark.createDataFrame([(1, None, "x", 0.5), (1, "", "y", 0.5), (None, "w " * 40_000, None, None), (2, "a text", "z", 1.0), (2, "a text", "z", 1.0)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        model = module.fit(d, labels)
        out = module.classify(d, model)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 5
        assert all(0 <= r["score"] <= 1 for r in out.collect())
        kept = module.keep_good(d, model) if module is quality else module.keep_clean(d, model)
        assert kept.columns == d.columns
    assert module.classify(d.limit(0), model).count() == 0


def test_dual_descent_separates():
    rows = [np.array([1, 5]), np.array([1, 6]), np.array([2, 5]), np.array([2, 6])] * 5
    y = np.array([1, 1, 0, 0] * 5)
    w, b = quality.dual_descent(rows, y, np.ones(quality.DIM))
    assert all((w[r].sum() + b > 0) == bool(v) for r, v in zip(rows, y, strict=True))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(10, 500, 20), 3 if i % 4 == 0 else 4)) for i in range(400)]
    model = toxicity.fit_rows(rows, np.array([int(i % 4 == 0) for i in range(400)]))
    assert 3 in model.index.tolist() and len(model.index) < 250


def test_word_pattern_matches_stated_one():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b\x0bc d") == [w.decode() for w in "a b\x0bc d".encode().split()]
