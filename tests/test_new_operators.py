"""Operators that have no SQL, against brute force on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import community, graph, vector
from quillgraph.operators.vector_index import VectorIndex
from quillgraph.sources import readers, sinks
from quillgraph.streaming import files


def slow_pagerank(edges, seeds, damping, rounds, dangling, passages, loops, devalue):
    nodes = sorted({n for e in edges for n in e[:2]} | set(seeds))
    adj = {n: {} for n in nodes}
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0) + w
        adj[b][a] = adj[b].get(a, 0) + w
    total = sum(seeds.values())
    p = {n: seeds.get(n, 0) / total for n in nodes}
    rank = dict(p)
    for _ in range(rounds):
        new, lost = {n: (1 - damping) * p[n] for n in nodes}, 0.0
        for n in nodes:
            loop = loops if n in passages and adj[n] else 0
            out = sum(adj[n].values()) + loop
            if not out:
                lost += damping * rank[n] if dangling else 0
                continue
            new[n] += damping * rank[n] * loop / out
            for m, w in adj[n].items():
                new[m] += damping * rank[n] * w / out / (max(len(adj[n]), 1) if devalue and n not in passages else 1)
        rank = {n: new[n] + lost * p[n] for n in nodes}
    return {n: v for n, v in rank.items() if v > 0}


@pytest.mark.parametrize(("dangling", "loops", "devalue"), [(False, 0.0, False), (True, 0.0, False), (True, 0.5, False), (False, 0.3, True)])
def test_pagerank_options(spark, dangling, loops, devalue):
    r = random.Random(1)
    edges = [(r.randrange(12), r.randrange(12, 24), r.choice((0.05, 1.0, 2.0))) for _ in range(30)]
    seeds = {0: 1.0, 3: 2.0, 99: 1.0}
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    s = spark.createDataFrame(list(seeds.items()), "node long, weight double")
    passages = set(range(12, 24))
    got = {x["node"]: x["score"] for x in graph.pagerank(e, s, rounds=4, dangling=dangling, passages=spark.createDataFrame([(n,) for n in passages], "node long"), self_loops=loops, devalue_hubs=devalue).collect()}
    want = slow_pagerank(edges, seeds, 0.5, 4, dangling, passages, loops, devalue)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    if dangling and not devalue:
        assert abs(sum(got.values()) - 1) < 1e-9
    assert graph.pagerank(e, s.limit(0), rounds=1).count() == 0


def test_modularity_finds_planted_groups(spark):
    cliques = [(g * 10 + i, g * 10 + j, 1.0) for g in range(3) for i in range(6) for j in range(i)]
    e = spark.createDataFrame([*cliques, (0, 10, 1.0), (11, 20, 1.0)], "src long, dst long, w double")
    found = {x["node"]: x["community"] for x in community.modularity_moves(e).collect()}
    assert len({found[n] for n in found}) == 3 and all(len({found[g * 10 + i] for i in range(6)}) == 1 for g in range(3))
    names = spark.createDataFrame([(n, f"n{n}") for n in found], "node long, name string")
    info = community.described(community.modularity_moves(e), e, names, 3).collect()
    assert all(len(x["members"].split(", ")) == 3 and " -> " in x["relations"] for x in info)


def test_blocks_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want, pairs = sorted(vector.top_k(q, df, 4).collect()), sorted(vector.similar_pairs(df, 0.2).collect())
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    assert [(p["a"], p["b"]) for p in pairs] == [(i, j) for i in range(60) for j in range(i + 1, 60) if round(cos[i, j], 6) >= 0.2]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    assert sorted(vector.top_k(q, df, 4).collect()) == want
    assert sorted(vector.similar_pairs(df, 0.2, 7).collect()) == pairs


def test_vector_index(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], {"label": str(i % 2)}) for i in range(6)], "vec_id long, embedding array<double>, metadata map<string,string>")
    index, n = VectorIndex(rows, 2).delete({"label": "1"})
    assert n.first()["n"] == 3 and sorted(r["vec_id"] for r in index.rows.collect()) == [0, 2, 4]
    q = rows.where("vec_id = 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert index.search(q, -1).count() == 0 and index.search(q, 0).count() == 3 and index.search(q, 1).first()["vec_id"] == 4
    with pytest.raises(Exception, match="2 places"):
        index.add(spark.createDataFrame([(9, [1.0], {})], rows.schema)).rows.collect()


def test_csv_with_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n"one, two",x\n"line\nend", y\nlast,"say ""hi"""\n')
    got = [(r["page"], r["offset"], r["content"]) for r in readers.csv_files(spark, str(tmp_path)).orderBy("page").collect()]
    assert got == [(0, 0, "one, two,x"), (1, 10, "line\nend,y"), (2, 20, 'last,say "hi"')]


def test_tables_and_index_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "eid long, sid long")
    assert sinks.ensure_table(df, "ensured_table") and not sinks.ensure_table(df, "ensured_table")
    assert "group_id" in spark.table("ensured_table").columns and spark.table("ensured_table").count() == 0
    sinks.write_index(df, str(tmp_path / "index"), "g")
    assert sorted((r["eid"], r["sids"], r["group_id"]) for r in spark.read.json(str(tmp_path / "index")).collect()) == [(1, [2, 3], "g"), (2, [2], "g")]
    events = df.select(F.col("eid").alias("event_id"), "sid").distinct()
    assert sinks.append_usage(events, str(tmp_path / "usage"), "g") == 2 and sinks.append_usage(events, str(tmp_path / "usage"), "g") == 0


def test_file_events(spark, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "table")
    schema = "event_id long, path string, kind string, content string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
    batch((1, "a", "uploaded", "A1"), (2, "b", "uploaded", "B1"), (3, "a", "uploaded", "A2"))
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    files.follow(stream(), out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in files.latest(spark, out).collect()) == [("a", "A2"), ("b", "B1")]
    batch((4, "b", "deleted", None), (5, "c", "uploaded", "C1"))
    files.follow(stream(), out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in files.latest(spark, out).collect()) == [("a", "A2"), ("c", "C1")]


def test_summary_tree_and_hierarchy(spark):
    rng = np.random.default_rng(5)
    rows = [(g * 100 + i, [float(10 * (g == j) + 0.1 * rng.normal()) for j in range(3)]) for g in range(3) for i in range(6)]
    tree = community.summary_tree(spark.createDataFrame(rows, "node long, embedding array<double>"), levels=2).collect()
    low = {r["node"]: r["parent"] for r in tree if r["level"] == 1}
    assert len(low) == 18 and all(len({low[g * 100 + i] for i in range(6)}) == 1 for g in range(3)) and len(set(low.values())) == 3
    assert {r["node"] for r in tree if r["level"] == 2} == set(low.values())
    assert community.summary_tree(spark.createDataFrame(rows[:1], "node long, embedding array<double>")).count() == 0
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (10, 11, 1.0), (11, 12, 1.0), (10, 12, 1.0), (2, 10, 0.1)], "src long, dst long, w double")
    levels = community.hierarchy(e, 1).collect()
    first = {r["node"]: r["community"] for r in levels if r["level"] == 0}
    assert len(set(first.values())) == 2 and first[0] == first[2] and first[10] == first[12]
