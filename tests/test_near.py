"""Approximate neighbours and the cell index, measured against brute force."""

import numpy as np
import pytest

from quillgraph.operators import cells, vector
from quillgraph.plans.catalog import QUERIES

KIND = "vec_id long, embedding array<float>"


def clustered(n=900, d=24, groups=30, seed=1, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(i, (centres[i % groups] + rng.normal(size=d) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_bands_find_nine_in_ten_pairs_and_no_wrong_one(spark, block_rows):
    rows = clustered(300) + [(1000 + i, clustered(1)[0][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 24), (2002, [1.0])]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    exact = {tuple(r) for r in vector.similar_pairs(df, 0.8).collect()}
    found = [tuple(r) for r in vector.banded_pairs(df, 0.8, block_rows=block_rows).collect()]
    assert len(found) == len(set(found)) and set(found) <= exact
    assert len(found) >= 0.9 * len(exact) and len(exact) > 2000
    assert vector.banded_pairs(df.limit(0), 0.8).collect() == []


def test_given_vectors_have_a_recall_of_nine_in_ten(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = {tuple(r) for r in vector.similar_pairs(df, 0.45).collect()}
    found = {tuple(r) for r in QUERIES["approximate_pairs"](spark, sf_dir).collect()}
    assert exact and found <= exact and len(found) >= 0.9 * len(exact)
    whole = {tuple(r) for r in QUERIES["cell_search_full"](spark, sf_dir).select("query_id", "vec_id").collect()}
    near = {tuple(r) for r in QUERIES["cell_search"](spark, sf_dir).select("query_id", "vec_id").collect()}
    assert len(near & whole) >= 0.9 * len(whole)


def test_bits_grow_with_the_rows_and_bands_with_the_bits():
    sizes = [vector.bands_for(0.7, n) for n in (100, 10_000, 1_000_000, 100_000_000)]
    assert sizes == sorted(sizes) and sizes[0][0] == 4 and sizes[-1][0] == 21


def test_cells_prune_folders_and_a_full_search_is_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 50)
    rows = clustered()
    df = spark.createDataFrame([*rows, (5000, None), (5001, [0.0] * 24)], KIND)
    folder = str(tmp_path / "index")
    cells.build(df, folder, cells=12)
    queries = spark.createDataFrame(rows[:5], KIND).toDF("query_id", "q")
    want = {tuple(r) for r in vector.top_k(queries, df.where("vec_id < 5000"), 8).collect()}
    assert {tuple(r) for r in cells.search(spark, folder, queries, 8, 12).collect()} == want
    near = cells.search(spark, folder, queries, 8, 2)
    assert len({tuple(r) for r in near.collect()} & want) >= 0.9 * len(want)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert spark.read.parquet(f"{folder}/rows").count() == len(rows)
    cells.build(df.limit(0), str(tmp_path / "none"), cells=4)
    assert cells.search(spark, str(tmp_path / "none"), queries, 3, 2).collect() == []
