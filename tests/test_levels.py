"""Communities in levels, matchings and assignments against brute force."""

import itertools
import random

import pytest

from quillgraph.operators import leiden, matching

EDGES = "src long, dst long, w double"


def blocks(seed, n=4, size=7, p=0.8, stray=10):
    r = random.Random(seed)
    inside = [(b * size + i, b * size + j, 1.0 + r.randrange(2)) for b in range(n) for i in range(size) for j in range(i + 1, size) if r.random() < p]
    return inside + [(r.randrange(n * size), r.randrange(n * size), 0.5) for _ in range(stray)]


def modularity(edges, label):
    total = 2 * sum(w for _, _, w in edges)
    inner, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
        if label[a] == label[b]:
            inner[label[a]] = inner.get(label[a], 0) + 2 * w
    return sum(inner.get(c, 0) / total - (d / total) ** 2 for c, d in degree.items())


def greedy(edges):
    """Best modularity of single-node moves from nodes that are alone, over several orders."""
    nodes, best = sorted({x for e in edges for x in e[:2]}), -1.0
    for seed in range(6):
        label, r = {x: x for x in nodes}, random.Random(seed)
        while True:
            before = modularity(edges, label)
            for x in r.sample(nodes, len(nodes)):
                near = {label[b if a == x else a] for a, b, _ in edges if x in (a, b)} | {label[x]}
                label[x] = max(sorted(near), key=lambda c, x=x: round(modularity(edges, {**label, x: c}), 12))
            if modularity(edges, label) <= before + 1e-9:
                break
        best = max(best, modularity(edges, label))
    return best


def is_connected(members, edges):
    members = set(members)
    seen, todo = set(), [min(members)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b, _ in edges if x in (a, b) and a in members and b in members]
    return seen == members


def test_levels_are_connected_nested_and_no_worse_than_single_moves(spark):
    edges = blocks(3)
    df = spark.createDataFrame([*edges, (None, 1, 1.0), (2, None, 1.0)], EDGES)
    found = leiden.hierarchy(df, most=3).collect()
    top = {r.node: r.community for r in found if r.level == 0}
    assert set(top) == {x for e in edges for x in e[:2]}
    assert modularity(edges, top) >= greedy(edges) - 1e-9
    assert abs(leiden.modularity(spark.createDataFrame(edges, EDGES), spark.createDataFrame(list(top.items()), "node long, community long")) - modularity(edges, top)) < 1e-9
    by = {}
    for r in found:
        by.setdefault((r.level, r.community), []).append(r)
    for (level, community), rows in by.items():
        members = [r.node for r in rows]
        assert community == min(members) and is_connected(members, edges)
        if level:
            up = {r.parent for r in rows}
            assert len(up) == 1 and set(members) < {r.node for r in by[level - 1, up.pop()]}


def test_moves_never_lower_what_they_raise_and_a_cycle_does_not_swap(spark):
    ring = [(i, (i + 1) % 12, 1.0) for i in range(12)]
    arcs = leiden.graph_of(spark.createDataFrame(ring, EDGES))
    nodes = leiden.blocks_of(arcs)
    alone = nodes.selectExpr("node", "node as community")
    label = leiden.moved(arcs, nodes, alone, 24.0, 0.0)
    assert leiden.quality(arcs, nodes, label) > leiden.quality(arcs, nodes, alone)
    assert leiden._best_moves(arcs, nodes, label).isEmpty()


def test_levels_of_nothing(spark):
    assert leiden.hierarchy(spark.createDataFrame([], EDGES)).collect() == []


@pytest.mark.parametrize("most", [1, 2])
def test_b_matching_equals_the_loop(spark, most):
    r = random.Random(most)
    edges = [(r.randrange(25), r.randrange(25), r.randrange(8) / 8) for _ in range(140)] + [(0, i, 0.5) for i in range(25)] + [(1, 2, None)]
    found = {(x.a, x.b, x.score) for x in matching.b_matching(spark.createDataFrame(edges, "a long, b long, score double"), most).collect()}
    best, used, want = {}, {}, set()
    for a, b, s in edges:
        if a != b and s is not None:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), -1))
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if used.get(a, 0) < most and used.get(b, 0) < most:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((a, b, s))
    assert found == want


def test_assignment_equals_all_assignments(spark):
    r = random.Random(4)
    rows = [(t, f"h{h}", f"f{f}", r.randrange(1, 6)) for t in range(25) for h in range(r.randrange(1, 5)) for f in range(4) if r.random() < 0.6]
    found = {}
    for x in matching.assigned(spark.createDataFrame(rows, "table_id long, header string, field string, score long")).collect():
        found.setdefault(x.table_id, {})[x.header] = (x.field, x.score)
    for t in {x[0] for x in rows}:
        own = {(h, f): s for u, h, f, s in rows if u == t}
        headers = sorted({h for h, _ in own})
        ways = itertools.product(*[[*sorted(f for h, f in own if h == x), "~"] for x in headers])
        ways = [w for w in ways if len([f for f in w if f != "~"]) == len({f for f in w if f != "~"})]
        best = min(ways, key=lambda w: (-sum(own[h, f] for h, f in zip(headers, w, strict=True) if f != "~"), w))
        assert found.get(t, {}) == {h: (f, own[h, f]) for h, f in zip(headers, best, strict=True) if f != "~"}


def test_headers_misspelt_and_swapped_find_their_fields(spark):
    names = spark.createDataFrame([("name", "customer name"), ("name", "client"), ("total", "total amount"), ("date", "due date")], "field string, name string")
    headers = spark.createDataFrame([(1, " Due dte "), (1, "Custmer Name"), (1, "totl amount"), (1, "colour"), (1, None), (2, "CLIENT"), (2, "client"), (3, "")], "table_id long, header string")
    found = {(r.table_id, r.header, r.field) for r in matching.assigned(matching.header_options(headers, names)).collect()}
    assert found == {(1, " Due dte ", "date"), (1, "Custmer Name", "name"), (1, "totl amount", "total"), (2, "CLIENT", "name")}
    cells = spark.createDataFrame([(1, 0, "colour", "red"), (1, 0, "totl amount", "5"), (1, 1, "totl amount", ""), (1, 2, "totl amount", None)], "table_id long, row_id long, header string, value string")
    assert [tuple(r) for r in matching.table_facts(cells, matching.assigned(matching.header_options(headers, names))).collect()] == [("Row_1_0", "5", "total", "totl amount")]


@pytest.mark.parametrize("arcs", [0, 60])
def test_rounds_of_jobs_give_good_levels_too(spark, monkeypatch, arcs):
    """Graphs beyond what a task holds, from the first level on or until they are contracted."""
    monkeypatch.setattr(leiden, "IN_TASK", arcs)
    edges = blocks(4, n=3, size=5, stray=4)
    found = leiden.hierarchy(spark.createDataFrame(edges, EDGES), most=100).collect()
    top = {r.node: r.community for r in found}
    assert len(found) == len(top) == 15 and modularity(edges, top) >= greedy(edges) - 0.02


def test_one_level_takes_few_jobs(spark):
    from quillgraph.operators import iterate

    made, own = [], iterate.durable
    leiden.durable = lambda df: made.append(1) or own(df)
    try:
        leiden.hierarchy(spark.createDataFrame(blocks(5), EDGES), most=100)
    finally:
        leiden.durable = own
    assert len(made) < 10
