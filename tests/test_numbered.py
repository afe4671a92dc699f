"""Places in whole tables without a task that holds a whole group."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import ranking as R
from quillgraph.operators import vector as V


def test_places_equal_a_sort(spark):
    """A group of most rows, ties, nulls first, and a null group."""
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else "hot" if i % 9 else f"g{i % 4}", rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, i int").repartition(7)
    order = [F.desc_nulls_first("s"), F.col("i")]
    key = lambda r: (r[1] is not None, -(r[1] or 0), r[2])
    got = {r.i: r.place for r in R.numbered(df, order, name="place").collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    want = {r[2]: n for g in {r[0] for r in rows} for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=key), 1)}
    assert {r.i: r["rank"] for r in R.numbered(df, order, "g").collect()} == want
    assert R.numbered(df.limit(0), order, "g").count() == 0


def test_every_score_is_there(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id in (0, 7)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert V.every(asked, vectors).count() == 100
    want = {tuple(r)[:3] for r in V.top_k(asked, vectors, 50, 0.9).collect()}
    assert {tuple(r) for r in V.every(asked, vectors, 0.9).collect()} == want
