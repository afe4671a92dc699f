"""Quality classifier: naive Bayes support vectors.

n-gram indicators are scaled by the log-count ratio of the two classes; a
linear hinge-loss model over the scaled indicators is fitted by dual
coordinate descent, and its margin is turned to a probability by a logistic
curve fitted on rows that the descent did not see.

n-grams are taken from two views of a text: its lower-cased words (1 and 2)
and the words' shapes (1 to 3), in which a run of lower-case letters,
capitals or digits is one sign, other signs stand for themselves, and a word
that repeats the one before it has a sign of its own.

Null texts count as empty and have a score like others; texts of any length
are read whole. Rows that repeat an id are scored each, and each may be a
training row. Labels that are null or have no id are ignored; with labels of
one class, or none, every score is that class's smoothed share. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, textvec
from .names import spare

DIM = 1 << 18
#: Most labelled rows that a model is fitted on.
FIT_ROWS = 8000
THRESHOLD = 0.5


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text (CSR)."""
    doc, word, shape, _ = textvec.tokens(data, offsets, textvec.NON_SPACE, shapes=True)
    if len(word):
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        shape = np.where(again, np.uint64(7), shape)
    views = [
        textvec.gram(doc, [(word, 0)], 1),
        textvec.gram(doc, [(word, 0), (word, 1)], 2),
        textvec.gram(doc, [(shape, 0)], 3),
        textvec.gram(doc, [(shape, 0), (shape, 1)], 4),
        textvec.gram(doc, [(shape, 0), (shape, 1), (shape, 2)], 5),
    ]
    return textvec.distinct(np.concatenate([d for d, _ in views]), np.concatenate([h for _, h in views]) & np.uint64(DIM - 1), len(offsets) - 1, DIM)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of each feature; p and q count the rows of class 1 and 0 that have it."""
    counts = []
    for label in (1, 0):
        own = [r for r, v in zip(rows, y, strict=True) if v == label]
        c = smooth + linear.frequencies(own, DIM)
        counts.append(c / (len(own) + 2 * smooth))
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over rows scaled to unit length; classes weigh the same together."""
    n = len(rows)
    w, bias = np.zeros(DIM), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    upper = np.where(y == 1, cost * n / (2 * max(1, y.sum())), cost * n / (2 * max(1, n - y.sum())))
    length = np.array([max(1e-9, np.sqrt((scale[r] ** 2).sum())) for r in rows])
    alpha, rng = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            values = scale[rows[i]] / length[i]
            grad = sign[i] * (w[rows[i]] @ values + bias) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), upper[i])  # unit length and a bias of 1: the diagonal is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    """weights and norms: what a feature adds to the margin and to the squared length of a row."""

    weights: np.ndarray
    norms: np.ndarray
    bias: float
    slope: float
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for lo, hi in textvec.groups(offsets):
            indptr, indices = featurize(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            owner = np.repeat(np.arange(hi - lo), np.diff(indptr))
            top = np.bincount(owner, weights=self.weights[indices], minlength=hi - lo)
            length = np.bincount(owner, weights=self.norms[indices], minlength=hi - lo)
            out[lo:hi] = top / np.sqrt(np.maximum(length, 1e-18)) + self.bias
        return linear.sigmoid(self.slope * out + self.intercept)


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit on feature rows. With rows of one class or none, every score is that class's smoothed share (0.5 without rows)."""
    ratio = log_count_ratio(rows, y)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(DIM, np.float32), np.ones(DIM, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(rows)) % 5 == 4
    inner = ~aside
    if len(set(y[inner].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        inner = aside = np.ones(len(rows), bool)
    some = [r for r, k in zip(rows, inner, strict=True) if k]
    r0 = log_count_ratio(some, y[inner])
    w, b = dual_descent(some, y[inner], r0)
    margins = np.array([(w[r] @ r0[r]) / max(1e-9, np.sqrt((r0[r] ** 2).sum())) + b for r, k in zip(rows, aside, strict=True) if k])
    slope, intercept = linear.platt(margins, y[aside])
    w, b = dual_descent(rows, y, ratio)
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(b), slope, intercept)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", fit_rows_: int = FIT_ROWS) -> Model:
    """Fit on at most `fit_rows_` labelled rows outside the held-out fold."""
    model = fit_rows(*linear.sample(documents, labels, label, fit_rows_, featurize))
    linear.release()
    return model


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability of label 1 for each whole text; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(*textvec.utf8(texts)))

    return score(text)


def classify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; further columns are not kept."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.select(
        "doc_id", linear.held_out(F.col("doc_id")).alias("held_out"), score_column(documents.sparkSession, model, F.col("_text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents`, all columns as they are, whose text scores as good."""
    (name,) = spare(documents, "score")
    marked = documents.withColumn(name, score_column(documents.sparkSession, model, F.col("text").cast("string")))
    return marked.where(F.col(name) >= THRESHOLD).drop(name)
