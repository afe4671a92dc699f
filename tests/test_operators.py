"""Operators on small fixtures whose results are known."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import iterate, ranking, resolve, routing
from quillgraph.operators import segment as S
from quillgraph.operators import vector as V
from quillgraph.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_canonical_key(spark):
    assert one(spark, T.canonical_key, "  ACME,  Corp. & Söhne ") == "acme corp & söhne"
    assert one(spark, T.canonical_key, None) is None


@pytest.mark.parametrize(
    "text,date", [("on 03/04/2021.", "2021-03-04"), ("2020-1-2", "2020-01-02"), ("March 5, 2019", "2019-03-05"), ("7. may 2018", "2018-05-07"), ("31.12.2017", "2017-12-31"), ("13/45/2020 or 1.1.1800", None), ("", None)]
)
def test_document_date(spark, text, date):
    found = one(spark, T.document_date, text)
    assert (found and found.isoformat()) == date


def test_sentences_split_and_filter(spark):
    df = spark.createDataFrame([(1, "This is one sentence here. TOO SHORT. Another proper sentence follows!"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r[2] for r in S.sentences(df).orderBy("idx").collect()] == ["This is one sentence here.", "Another proper sentence follows!"]


def test_join_stubs(spark):
    df = spark.createDataFrame([(1, 0, "Terms:"), (1, 1, "paid in full now."), (1, 2, "The end is near."), (2, 0, "Note")], "doc_id long, idx long, text string")
    assert rows(S.join_stubs(df)) == [(1, 0, "Terms: paid in full now."), (1, 2, "The end is near."), (2, 0, "Note")]


def test_next_fit_against_a_loop(spark):
    r = random.Random(1)
    data = [(d, i, r.randint(1, 50)) for d in range(5) for i in range(20)]
    want = []
    for d in range(5):
        number, used = 0, 0
        for _, i, n in [x for x in data if x[0] == d]:
            if used and used + n > 60:
                number, used = number + 1, 0
            used += n
            want.append((d, i, number))
    df = spark.createDataFrame(data, "doc_id long, idx long, tokens long")
    assert rows(S.next_fit(df, 60)) == sorted(want)


def test_windows_cover_every_word(spark):
    words = [f"w{i}" for i in range(1200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, ""), (4, None)], "doc_id long, text string")
    got = S.windows(df).where("doc_id = 1").orderBy("chunk_index").collect()
    assert set(" ".join(r["chunk"] for r in got).split()) == set(words)
    assert {r["doc_id"] for r in S.windows(df).collect()} == {1, 2}


def test_pagerank_sums_to_one_and_favours_seeds(spark):
    edges = spark.createDataFrame([("e1", "e2", 1.0), ("e2", "e3", 1.0), ("p1", "e1", 0.05), ("p2", "e2", 0.05), ("p2", "e3", 0.05)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("e1", 1.0)], "node string, weight double")
    score = {r["node"]: r["score"] for r in G.pagerank(edges, seeds, rounds=12).collect()}
    assert abs(sum(score.values()) - 1) < 1e-9
    assert max(score, key=score.get) == "e1" and score["p1"] > score["p2"] > 0


def test_interval_join_against_all_pairs(spark):
    r = random.Random(2)
    make = lambda n: [(r.randint(0, 2), i, (s := r.randint(0, 2000)), s + r.randint(1, 700)) for i in range(n)]
    a, b = make(60), make(60)
    want = sorted((d, i, j, min(e, e2) - max(s, s2)) for d, i, s, e in a for d2, j, s2, e2 in b if d == d2 and s < e2 and s2 < e)
    df = lambda x: spark.createDataFrame(x, "doc_id long, id long, start long, end long")
    assert rows(G.overlapping(df(a), df(b))) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    found = {r["node"]: r["root"] for r in resolve.components(edges).collect()}
    assert {found[i] for i in range(61)} == {0} and found[101] == 100


def test_entity_resolution(spark):
    names = spark.createDataFrame([("Acme Corp",), ("ACME corp.",), ("International Business Machines",), ("IBM",), ("Other",), (None,)], "name string")
    m = {r["name"]: r["canonical"] for r in resolve.merge_map(names).collect()}
    assert m["International Business Machines"] == m["IBM"] == "IBM" and m["ACME corp."] == m["Acme Corp"] == "Acme Corp" and m["Other"] == "Other"
    names = spark.createDataFrame([("Dr. Smith",), ("Doctor Smith",), ("J. Smith",), ("John Smith",), ("Jane Doe",), ("North East Trading House",), ("North West Trading House",), ("Globex",), ("Initech",)], "name string")
    vectors = spark.createDataFrame([(1, "Globex", [1.0, 0.0]), (2, "Initech", [1.0, 0.01]), (3, "Jane Doe", [0.0, 1.0])], "vec_id long, name string, embedding array<double>")
    m = {r["name"]: r["canonical"] for r in resolve.merge_map(names, vectors).collect()}
    assert m["Doctor Smith"] == "Dr. Smith" and m["John Smith"] == "J. Smith" and m["Jane Doe"] == "Jane Doe" and m["North West Trading House"] == "North East Trading House" and m["Initech"] == "Globex"


@pytest.mark.parametrize(("a", "b", "want"), [("Dr. Smith", "doctor smith", True), ("J. Smith", "John Smith", True), ("Int'l Bank", "International Bank", True), ("Ann Lee", "Ann Ray", False), ("A B C D", "A B C E", True), ("a b c", "a b d", False), ("", "", False)])
def test_abbreviations(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(resolve.is_abbreviation(F.col("a"), F.col("b"))).first()[0]
    assert got == want


def test_similar_pairs_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(60, [0.0] * 8)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if round(float(x[i] @ x[j]), 6) >= 0.5)
    assert [(a, b) for a, b, _ in rows(V.similar_pairs(df, 0.5, block_rows=17))] == want


def test_rrf_and_diversify(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    best = ranking.rrf(a, b).orderBy(F.desc("score")).first()
    assert best["id"] == 2 and best["hits"] == 2
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.99), (3, "a", 0.98), (4, "b", 0.9), (5, "c", 0.1)], "id long, doc_id string, score double")
    assert {r["id"] for r in ranking.diversify(df, 3).collect()} == {1, 2, 4}


def test_routes(spark):
    assert one(spark, routing.route, "How does A relate?") == "multi_hop"
    assert one(spark, routing.date_order, "the oldest contract") == "asc"


@pytest.mark.parametrize("url,ok", [("https://a.example.com/x", True), ("http://10.1.2.3/", False), ("http://localhost:80", False), ("ftp://x", False), ("http://user@192.168.0.1/", False), (None, False)])
def test_safe_url(spark, url, ok):
    assert one(spark, readers.safe_url, url) is ok


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("h1,h2\n1, x\n2,y\n")
    got = readers.csv_files(spark, str(tmp_path / "in" / "a.csv")).orderBy("page").collect()
    assert [(r["page"], r["offset"], r["content"]) for r in got] == [(0, 0, "1,x"), (1, 3, "2,y")]
    j = spark.createDataFrame([("[{\"a\":1},{\"a\":2}]",), ('{"b":3}',)], "body string")
    assert sorted(r["content"] for r in readers.json_pages(j, "body").collect()) == ['{"a":1}', '{"a":2}', '{"b":3}']
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    out = str(tmp_path / "table")
    assert sinks.append_new(df, out, ["id"], "g") == 2 and sinks.append_new(df.unionAll(df), out, ["id"], "g") == 0
    assert spark.read.parquet(out).where("group_id = 'g'").count() == 2


def test_durable_keeps_rows(spark):
    assert iterate.durable(spark.range(5)).count() == 5


def test_label_propagation_finds_cliques(spark):
    from quillgraph.operators import community

    cliques = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    found = {r["node"]: r["community"] for r in community.label_propagation(spark.createDataFrame(cliques, "src long, dst long, w double")).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(10, 15)}) == 1 and found[0] != found[12]


def test_mmr_prefers_new_directions(spark):
    from quillgraph.operators import similar

    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0]), (1, 4, 0.1, None)]
    got = similar.mmr(spark.createDataFrame(rows, "query_id long, id long, score double, embedding array<double>"), k=3).orderBy("position").collect()
    assert [r["id"] for r in got][:2] == [1, 3]


def test_set_similarity_against_all_pairs(spark):
    from quillgraph.operators import similar

    r = random.Random(9)
    base = [[f"w{r.randrange(60)}" for _ in range(30)] for _ in range(6)]
    data = []
    for i in range(60):
        words = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            words[r.randrange(len(words))] = f"x{r.randrange(99)}"
        data.append((i, "g" if i % 3 else "h", " ".join(words)))
    data.append((99, "g", None))
    want = {}
    for i, g, t in data:
        for j, g2, u in data:
            if g == g2 and j < i and t and u:
                a, b = set(t.split()), set(u.split())
                if len(a & b) >= 0.92 * len(a | b):
                    want[i] = min(j, want.get(i, j))
    got = {x["id"]: x["first"] for x in similar.jaccard_repeats(spark.createDataFrame(data, "id long, grp string, text string"), "grp").collect()}
    assert got == want


def test_many_query_blocks(spark, monkeypatch):
    from quillgraph.operators import vector

    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = rows(vector.top_k(queries, vectors, 3))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    assert rows(vector.top_k(queries, vectors, 3)) == whole and len(whole) == 120


def test_percentiles_of_repeated_values(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(1000)] + [(None,)], "v double")
    got = {r["share"]: r["value"] for r in V.nearest_rank(df, "v", [0.0, 0.1, 0.11, 0.5, 1.0], ranges=8).collect()}
    assert got == {0.0: 0.0, 0.1: 0.0, 0.11: 1.0, 0.5: 4.0, 1.0: 9.0}
    assert V.nearest_rank(df.limit(0), "v", [0.5]).count() == 0


@pytest.mark.parametrize("block", [7, 256])
def test_common_entities_are_shared(spark, block):
    r = random.Random(4)
    units = [(d, s) for d in range(20) for s in range(5)]
    own = {u: {1, 2} | {e for e in range(3, 12) if r.random() < 0.2} for u in units}
    own[(0, 0)] = {1}
    sentences = spark.createDataFrame([(i, *u) for i, u in enumerate(units * 2)], "sid long, doc_id long, section_id long")
    mentions = spark.createDataFrame([(i, e) for i, u in enumerate(units * 2) for e in own[u]], "sid long, eid long")
    got = {tuple(x)[:4]: x["shared"] for x in G.shares_entity(mentions, sentences, block=block).collect()}
    want = {(*a, *b): len(own[a] & own[b]) for a in units for b in units if a[0] < b[0] and len(own[a] & own[b]) >= 2}
    assert got == want


def test_gap_over_many_ranges(spark):
    """The first fall is found across ranges, and no range is ranked as one partition."""
    for scores, keep in (([1000.0 - i for i in range(400)] + [200.0] * 50, 400), ([1000.0 - i for i in range(450)], 450), ([8.0, 1.0, 1.0], 3)):
        df = spark.createDataFrame(list(enumerate(scores)), "id long, score double")
        got = rows(ranking.gap_prune(df))
        assert got == [(i, scores[i], i + 1) for i in range(keep)]
    plan = ranking.gap_prune(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("p#" in line.split("row_number()")[1].split("]")[0] or ", [p#" in line for line in plan.splitlines() if "Window [row_number()" in line)
    assert ranking.gap_prune(df.limit(0)).count() == 0


def test_pagerank_converges(spark):
    """On a path of 12 nodes: mass reaches nodes over 6 hops off, as in iteration to the end."""
    n, d = 12, 0.5
    edges = spark.createDataFrame([(i, i + 1, 1.0 + i % 2) for i in range(n - 1)], "src long, dst long, w double")
    w = [[0.0] * n for _ in range(n)]
    for i in range(n - 1):
        w[i][i + 1] = w[i + 1][i] = 1.0 + i % 2
    seed = [1.0] + [0.0] * (n - 1)
    score = seed
    for _ in range(200):
        score = [(1 - d) * seed[j] + d * sum(score[i] * w[i][j] / sum(w[i]) for i in range(n)) for j in range(n)]
    got = {r["node"]: r["score"] for r in G.pagerank(edges, spark.createDataFrame([(0, 2.0)], "node long, weight double"), d).collect()}
    assert set(got) == set(range(n)) and sum(abs(got[i] - score[i]) for i in range(n)) < 2e-6
