"""Greedy cuts by pointers against the loop that they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import cuts, passages


def loop(sizes, most, count=None, overlap=0):
    """Piece of each row."""
    out, piece, used, rows = [], 0, 0, 0
    for i, s in enumerate(sizes):
        if i and (used + s > most or (count and rows == count)):
            piece, rows = piece + 1, 0
            used = overlap if overlap and used > overlap else 0
        used, rows = used + s, rows + 1
        out.append(piece)
    return out


def table(spark, groups):
    rows = [(g, i, s, "x") for g, sizes in groups.items() for i, s in enumerate(sizes)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, i long, s int, size string")


@pytest.mark.parametrize(("most", "count", "overlap"), [(10, None, 0), (10, 3, 0), (7, None, 3)])
def test_pieces_equal_the_loop(spark, most, count, overlap):
    r = random.Random(most)
    groups = {"long": [r.choice((0, 1, 1, 2, 3, 15)) for _ in range(700)], None: [r.randint(0, 12) for _ in range(40)], "one": [99], "zero": [0] * 9, "big": [20, 20, 0, 20]}
    found = cuts.greedy(table(spark, groups), ["g"], ["i"], F.col("s"), most, count, overlap).collect()
    for g, sizes in groups.items():
        own = sorted((x for x in found if x.g == g), key=lambda x: x.i)
        assert [x.piece for x in own] == loop(sizes, most, count, overlap), g
        assert [x.place for x in own] == list(range(len(sizes)))


def test_no_piece_of_several_rows_is_over_the_limit(spark):
    r = random.Random(5)
    found = cuts.greedy(table(spark, {"a": [r.randint(0, 400) for _ in range(500)]}), ["g"], ["i"], F.col("s"), 900)
    assert found.groupBy("piece").agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("n")).where("n > 1 and t > 900").count() == 0


def test_a_long_group_lies_in_many_parts_and_nulls_count_as_nothing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one part
    rows = cuts.ranged(spark.range(4000).select(F.lit("one").alias("g"), F.col("id").alias("i")), ["g"], ["i"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [x["count"] for x in rows.groupBy("__part").count().collect()]
    assert len(per) > 1 and max(per) < 2500
    odd = spark.createDataFrame([("a", 1, None), ("a", 2, -5), ("a", 3, 4), ("a", 4, 4)], "g string, i int, s int")
    assert [x.piece for x in cuts.greedy(odd, ["g"], ["i"], F.col("s"), 5).orderBy("i").collect()] == [0, 0, 0, 1]
    assert cuts.greedy(odd.limit(0), ["g"], ["i"], F.col("s"), 5).collect() == []


def split(text, most, overlap):
    pieces, now, used = [], "", 0
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        n = len(p.split())
        if not now or used + n <= most:
            now, used = (f"{now}\n\n{p}" if now else p), used + n
        else:
            pieces.append(now)
            w = now.split()
            now = " ".join(w[-overlap:]) + "\n\n" + p if len(w) > overlap else p
            used = len(now.split())
    return [*pieces, now] if now else pieces


def test_large_sections_split_like_the_loop(spark):
    r = random.Random(9)
    texts = ["\n\n".join(" ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice((1, 2, 5, 9, 40)))) for _ in range(r.randint(1, 60))) for _ in range(12)] + ["", "\n\n\n\n", "one"]
    found = passages.split_large(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 30, 8).collect()
    for i, text in enumerate(texts):
        assert [x.text for x in sorted((x for x in found if x.doc_id == i), key=lambda x: x.piece)] == split(text, 30, 8)


def test_halves_go_as_deep_as_the_text_asks_for(spark):
    found = passages.halves(spark.createDataFrame([(1, "a" * 70_000), (2, ""), (3, None), (4, " " * 9000)], "doc_id long, text string"), 3).collect()
    assert max(len(x.text or "") for x in found) <= 11
    assert "".join(x.text for x in sorted((x for x in found if x.doc_id == 1), key=lambda x: x.piece)) == "a" * 70_000


def test_csv_rows_of_any_width_are_read_whole(spark, tmp_path):
    from quillgraph.sources import readers

    wide = [f"v{i}" for i in range(200)]
    wide[70] = '"a, ""b"" c"'
    (tmp_path / "w.csv").write_text(",".join(f"h{i}" for i in range(200)) + "\n" + ",".join(wide) + "\nx,y\n")
    got = [x.content for x in readers.csv_files(spark, str(tmp_path)).orderBy("page").collect()]
    assert got == [",".join([*wide[:70], 'a, "b" c', *wide[71:]]), "x,y"]


def test_descendants_of_any_depth_and_in_a_cycle(spark):
    from quillgraph.operators import graph, lifecycle

    deep = [(i, i - 1 if i else None) for i in range(30)]
    tree = spark.createDataFrame([*deep, (100, 101), (101, 100)], "id long, parent long")
    assert {(x.id, x.depth) for x in graph.descendants(tree, F.lit(3)).collect()} == {(i, i - 3) for i in range(3, 30)}
    assert {x.id for x in graph.descendants(tree, F.lit(100)).collect()} == {100, 101}
    assert {x.id for x in lifecycle.without_folder(tree, F.lit(5)).collect()} == {0, 1, 2, 3, 4, 100, 101}
