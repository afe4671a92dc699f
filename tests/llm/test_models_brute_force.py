"""The two text models against plain loops over dictionaries."""

import math
import random

import numpy as np

from quillgraph.llm import quality, toxicity


def sample(n=40, seed=1):
    r = random.Random(seed)
    rows = [np.array(sorted(r.sample(range(50), r.randint(1, 12))), np.int32) for _ in range(n)]
    return rows, np.array([int(3 in x or r.random() < 0.3) for x in rows])


def test_log_count_ratio():
    rows, y = sample()
    got = quality.log_count_ratio(rows, y)
    pos, neg = [r for r, v in zip(rows, y, strict=True) if v], [r for r, v in zip(rows, y, strict=True) if not v]
    for f in (*range(50), 51):
        p, q = (1 + sum(f in set(r.tolist()) for r in own) for own in (pos, neg))
        assert abs(got[f] - math.log((p / (len(pos) + 2)) / (q / (len(neg) + 2)))) < 1e-12


def test_dual_descent_solves_its_problem():
    """No dual step is left: the weights are those of the alphas, and every alpha fits its margin."""
    rows, y = sample()
    scale = quality.log_count_ratio(rows, y)
    w, b = quality.dual_descent(rows, y, scale, epochs=3000)
    n, pos = len(rows), int(y.sum())
    objective = lambda w, b: 0.5 * (w @ w + b * b) + sum((n / (2 * pos) if v else n / (2 * (n - pos))) * max(0.0, 1 - (1 if v else -1) * (w[r] @ (scale[r] / max(1e-9, np.sqrt((scale[r] ** 2).sum()))) + b)) for r, v in zip(rows, y, strict=True))
    best, rng = objective(w, b), np.random.default_rng(2)
    for size in (0.3, 0.03, 0.003):
        for _ in range(60):
            step = np.zeros_like(w)
            step[:50] = rng.normal(size=50) * size
            assert objective(w + step, b + rng.normal() * size) >= best - 1e-2


def test_quality_score_of_a_text():
    texts = ["Alpha beta beta, gamma.", "", "x", "Alpha"]
    r = np.random.default_rng(3)
    model = quality.Model(r.normal(size=quality.DIM).astype(np.float32), r.random(quality.DIM).astype(np.float32), 0.3, 1.7, -0.2)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = model.score(data, offsets)
    for t, s in zip(texts, got, strict=True):
        own = np.frombuffer(t.encode(), np.uint8)
        _, f = quality.featurize(own, np.array([0, len(own)]))
        f = set(f.tolist())
        margin = sum(float(model.weights[i]) for i in f) / math.sqrt(max(sum(float(model.norms[i]) for i in f), 1e-18)) + 0.3
        assert abs(s - 1 / (1 + math.exp(-(1.7 * margin - 0.2)))) < 1e-6


def test_ftrl_against_a_plain_loop():
    rows, y = sample(60, 4)
    alpha, beta, l1, l2 = 1.5, 1.0, 0.5, 0.5
    got = toxicity.fit_rows(rows, y, alpha, beta, l1, l2, least=1, seed=11)
    z, n, rng = {}, {}, np.random.default_rng(11)

    def weight(i):
        zi, free = z.get(i, 0.0), i == "bias"
        if not free and abs(zi) <= l1:
            return 0.0
        return -(zi - (0 if free else math.copysign(l1, zi))) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(toxicity.PASSES):
        for r in rng.permutation(len(rows)):
            names = [*rows[r].tolist(), "bias"]
            w = {i: weight(i) for i in names}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[r]
            for i in names:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i) != 0}
    assert dict(zip(got.index.tolist(), got.value.tolist(), strict=True)).keys() == want.keys()
    assert all(abs(v - want[i]) < 1e-5 for i, v in zip(got.index.tolist(), got.value.tolist(), strict=True)) and abs(got.bias - weight("bias")) < 1e-9


def test_few_rows_are_fitted_like_many():
    rows = [np.array([1, 2], np.int32), np.array([3], np.int32)]
    model = quality.fit_rows(rows, np.array([1, 0]))
    assert model.weights[1] > 0 > model.weights[3]


def test_helper_columns_clash_with_none(spark):
    df = spark.createDataFrame([(1, "some plain text", 0.1, 0.2)], "doc_id long, text string, __score double, __SCORE_ double")
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -3.0)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "some plain text", 0.1, 0.2)]
