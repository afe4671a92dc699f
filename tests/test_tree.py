"""Summary trees against loops."""

from collections import Counter

import numpy as np

from quillgraph.operators import tree

KIND = "node long, embedding array<double>"


def made(n=60, d=4, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d)) * 4
    return [(i, (centres[i % 4] + rng.normal(size=d)).tolist()) for i in range(n)]


def test_tree_has_soft_parents_weighted_means_and_is_searched_whole(spark):
    rows = made()
    df = spark.createDataFrame([*rows, (900, None), (901, [1.0])], KIND)
    nodes, links = tree.grown(df, levels=2, most=5, least=1e-6)
    found = {r.node: r for r in nodes.collect()}
    arcs = links.collect()
    vector = {k: np.array(r.embedding) for k, r in found.items()}
    assert {k for k, r in found.items() if r.level == 0} == {i for i, _ in rows}
    by_child, by_parent = {}, {}
    for a in arcs:
        by_child.setdefault(a.child, []).append(a)
        by_parent.setdefault(a.parent, []).append(a)
    assert any(len(x) > 1 for x in by_child.values())  # soft
    top = max(r.level for r in found.values())
    assert all(k in by_child for k, r in found.items() if r.level < top)
    for parent, own in by_parent.items():
        w = np.array([a.weight for a in own])
        mean = (w[:, None] * np.array([vector[a.child] for a in own])).sum(axis=0) / w.sum()
        assert np.allclose(mean, vector[parent]) and found[parent].child_count == len(own)
        assert all(found[a.child].level == found[parent].level - 1 for a in own)
    q = np.array(rows[7][1])
    score = {k: round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6) for k, v in vector.items()}
    want = sorted(score, key=lambda k: (-score[k], k))[:6]
    queries = spark.createDataFrame([(1, rows[7][1])], "query_id long, q array<double>")
    assert [r.node for r in tree.search(nodes, queries, 6).orderBy("rank").collect()] == want
    assert {r.level for r in tree.search(nodes, queries, 3, level=1).collect()} == {1}

    def below(x):
        return set().union(*(below(a.child) for a in by_parent[x])) if x in by_parent else {x}

    mentions = [(i, e) for i, _ in rows for e in (i % 7, i % 5 + 10)]
    got = {(r.root, r.eid): r.mentions for r in tree.entities_below(links, spark.createDataFrame(mentions, "sid long, eid long"), nodes.where("level > 0").select("node")).collect()}
    assert got == {(x, e): n for x in by_parent for e, n in Counter(e for i, e in mentions if i in below(x)).items()}
    assert all(-1 <= r.coherence <= 1 for r in tree.coherence(nodes, links).collect())


def test_tree_of_one_or_no_vector(spark):
    for rows in ([], [(1, [1.0, 2.0])]):
        nodes, links = tree.grown(spark.createDataFrame(rows, KIND))
        assert nodes.count() == len(rows) and links.count() == 0
