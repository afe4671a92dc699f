"""Queries over whole tables reach every row."""

from hashlib import md5

from conftest import SMALL

from quillgraph.plans import catalog


def test_every_row_has_a_result(spark):
    q = catalog.queries()
    table = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    assert q["all_moved_documents"](spark, SMALL).count() == table("documents").count()
    weights = {r["node"] for r in q["all_seed_weights"](spark, SMALL).collect()}
    assert {f"e{r[0]}" for r in table("lineitem").select("l_partkey").distinct().collect()} <= weights
    names = {r["p_name"] for r in table("part").select("p_name").collect()}
    seeds = {r["p_name"] for r in table("part").where("p_partkey <= 20").select("p_name").collect()}
    words = {w for s in seeds for w in s.lower().split(" ") if len(w) >= 3}
    want = {n for n in names if words & set(n.lower().split(" "))}
    assert {r["name"] for r in q["token_overlap_all_parts"](spark, SMALL).collect()} == want


def test_inverted_index_has_whole_lists(spark, tmp_path):
    """One row an entity, whatever numbers its sentences have; null numbers count and are not listed."""
    lines = [(sid, 7) for sid in (5, 999, 1000, 100_000, 2_500_000, 99_999, 5)] + [(3, 8), (None, 8), (None, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["eid"]: (r["n"], r["listed"]) for r in catalog.queries()["inverted_index"](spark, str(tmp_path)).collect()}
    digest = lambda text: md5(text.encode()).hexdigest()
    assert got == {7: (6, digest("5,999,1000,99999,100000,2500000")), 8: (2, digest("3")), 9: (1, None)}
    index = catalog.queries()["inverted_index"](spark, SMALL)
    assert index.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey").distinct().count()
