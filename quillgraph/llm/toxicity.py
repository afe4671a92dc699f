"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip one word of a
text (letters, digits and non-ASCII characters make words; A-Z count as a-z),
and the stems of its longer words.
Each coordinate has a learning rate of its own, and the L1 term keeps most
weights at exactly zero: only the others are broadcast.

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

DIM = 1 << 20
#: Most labelled rows that a model is fitted on.
FIT_ROWS = 10000
#: Passes over them, however many they are.
PASSES = 8
THRESHOLD = 0.7
#: Descending lengths in bytes of the word stems that count as features too, so that inflected words are known by their stem.
STEMS = (8, 7, 6, 5)


def featurize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and skip-grams of each text (CSR)."""
    doc, word, _, stems = textvec.tokens(data, offsets, textvec.ALNUM, stems=STEMS)
    views = [
        textvec.gram(doc, [(word, 0)], 11),
        textvec.gram(doc, [(word, 0), (word, 1)], 12),
        textvec.gram(doc, [(word, 0), (word, 2)], 13),
    ]
    for k, stem in zip(STEMS, stems, strict=True):
        own = np.flatnonzero(stem)
        views.append(textvec.gram(doc[own], [(stem[own], 0)], 20 + k))
    return textvec.distinct(np.concatenate([d for d, _ in views]), np.concatenate([h for _, h in views]) & np.uint64(DIM - 1), len(offsets) - 1, DIM)


@dataclass
class Model:
    """The weights that are not zero, sorted by feature."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        dense = getattr(self, "_dense", None)
        if dense is None:
            dense = np.zeros(DIM, np.float32)
            dense[self.index] = self.value
            self._dense = dense
        return linear.sigmoid(linear.margin(data, offsets, featurize, dense) + self.bias)

    def __getstate__(self):
        return {"index": self.index, "value": self.value, "bias": self.bias}


def fit_rows(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.5, beta: float = 1.0, l1: float = 5.0, l2: float = 0.5, least: int = 1, seed: int = 11) -> Model:
    """PASSES passes over the rows in seeded order; with `least` over 1, features in fewer rows are left out. With one class or none, every score is that class's smoothed share."""
    none = np.zeros(0, np.int64)
    if len(rows) < 2 or len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(none, none.astype(np.float32), float(np.log(share / (1 - share))))
    if least > 1:
        rows = linear.only(rows, linear.frequencies(rows, DIM) >= least)
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def current(idx):
        zi = z[idx]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    free = np.array([DIM])  # the bias has no L1 term

    def bias():
        return float(-z[DIM] / ((beta + np.sqrt(n[DIM])) / alpha + l2))

    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            idx = rows[i]
            w, b = current(idx), bias()
            g = linear.sigmoid(w.sum() + b) - y[i]
            for at, old in ((idx, w), (free, b)):
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - sigma * old
                n[at] += g * g
    idx = np.flatnonzero(np.abs(z[:DIM]) > l1)
    return Model(idx, current(idx).astype(np.float32), bias())


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows_: int = FIT_ROWS) -> Model:
    """Fit on at most `fit_rows_` labelled rows outside the held-out fold."""
    rows, y = linear.sample(documents, labels, label, fit_rows_, featurize)
    model = fit_rows(rows, y)
    del rows
    linear.release()
    return model


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability that each whole text is toxic; null counts as empty."""
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


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents`, all columns as they are, whose text does not score as toxic."""
    (name,) = spare(documents, "score")
    marked = documents.withColumn(name, score_column(documents.sparkSession, model, F.col("text").cast("string")))
    return marked.where(F.col(name) < THRESHOLD).drop(name)
