"""Health of groups from counts, and penalties of form lines."""

import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import facts as A
from quillgraph.operators import lifecycle as L
from quillgraph.operators import noise as N

COUNTS = "orphans long, entities long, stale long, is_stale boolean, missing long, deprecated long, documents long"


@pytest.mark.parametrize(
    ("counts", "score"),
    [
        ((0, 0, 0, False, 0, 0, 0), 100.0),
        ((1, 10, 0, False, 0, 0, 4), 90.0),
        ((9, 10, 0, False, 0, 0, 4), 80.0),
        ((0, 10, 33, False, 0, 0, 4), 96.7),
        ((0, 10, 900, True, 0, 2, 4), 75.0),
        ((0, 10, 0, False, 2, 3, 4), 85.0),
        ((10, 10, 900, True, 90, 4, 4), 15.0),
    ],
)
def test_health_score(spark, counts, score):
    assert L.health_score(spark.createDataFrame([counts], COUNTS)).first().score == score


def test_health_counts(spark):
    """A document in two groups, an entity that only dead sentences of a group mention, an edge to a sentence without a group, a group never computed."""
    s = spark.createDataFrame([(1, 1, "a", False), (2, 1, "a", True), (3, 2, "a", True), (4, 2, "b", False), (5, 3, None, True)], "sid long, doc_id long, group_id string, deprecated boolean")
    m = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (3, 8), (4, 8), (9, 9), (5, 6)], "sid long, eid long")
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 4), (3, 1), (4, 5), (5, 4)], "src long, dst long")
    day = datetime.date(2024, 1, 1)
    c = spark.createDataFrame([("a", day, day), ("b", day, None)], "group_id string, last_change date, last_computed date")
    v = L.isolation({"s": s})
    rows = {r.group_id: r for r in L.health(s, m, e, c, v).collect()}
    got = {g: (r.documents, r.deprecated, r.entities, r.orphans, r.stale, r.is_stale, r.missing, r.score) for g, r in rows.items()}
    assert got == {"a": (2, 1, 2, 1, 2, False, 1, 74.8), "b": (1, 0, 1, 0, 0, True, 1, 85.0)}
    assert L.health(s.limit(0), m, e, c, v).count() == 0


def test_noise_penalties(spark):
    long_ = "word " * 60
    cases = {
        "Name: ____\nDate:\n" + long_: 0.05,
        "Yes: [ ]\n" + long_: 0.05,
        "----\n....\n" + long_ + "\n" + long_: 0.05,
        "\t\nName: ____\r\n" + long_ + "\n" + long_: 1.0,
        "Name: ____ signed\n" + long_: 1.0,
        long_: 1.0,
        "Répété à côté ñandú élan": 0.2,
        "Authorized Representative: Fabrikam": 1.0,
        "": 0.002,
        " \t\n ": 0.002,
        "ab # * > |": 0.02,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", N.noise_penalty(F.col("t")).alias("p"))
    assert {r.t: r.p for r in rows.collect()} == cases | {None: 0.002}


def test_default_vector_is_signed_counts_of_hashed_words(spark):
    texts = ["The cat, the DOG; $5", "", None, "¿é?", "a b c d e f g h i j k l m n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", A.hashed_vector(F.col("t")).alias("v")).orderBy("i").collect()
    for row, text in zip(got, texts, strict=True):
        want = np.zeros(64)
        for w in {"".join(c if c.isascii() and (c.isalnum() or c in "$%") else " " for c in x) for x in (text or "").lower().split()}:
            for part in w.split():
                h = zlib.crc32(part.encode())
                want[h % 64] += -1 if h >= 2**31 else 1
        norm = np.linalg.norm(want)
        assert np.allclose(row.v, want / norm if norm else want)


def test_default_vector_of_words_that_cancel_is_of_unit_length(spark):
    """`sun` and `sea` fall on one place with opposite signs."""
    rows = spark.createDataFrame([(1, "Sun, sea!"), (2, "?!")], "i int, t string")
    got = {r.i: np.linalg.norm(r.v) for r in rows.select("i", A.hashed_vector(F.col("t")).alias("v")).collect()}
    assert np.isclose(got[1], 1) and got[2] == 0
