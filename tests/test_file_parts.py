"""A table kept up to date by changed parts."""

from pathlib import Path

from quillgraph.streaming import files

EVENTS = "event_id long, path string, kind string, content string"


def names(folder):
    return {str(p) for p in Path(folder).rglob("*.parquet")}


def state(spark, folder):
    return {r.path: r.content for r in files.latest(spark, folder).collect()}


def test_a_batch_rewrites_the_parts_it_touches_and_no_others(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert files.latest(spark, folder) is None
    first = spark.createDataFrame([(i, f"p{i}", "uploaded", f"c{i}") for i in range(200)], EVENTS)
    assert files.merge(first, folder, 0, 16)
    before = names(f"{folder}/data")
    second = spark.createDataFrame([(500, "p3", "deleted", None), (501, "p4", "uploaded", "old"), (502, "p4", "uploaded", "new"), (503, "fresh", "uploaded", "f")], EVENTS)
    assert files.merge(second, folder, 1, 16)
    want = {f"p{i}": f"c{i}" for i in range(200) if i != 3} | {"p4": "new", "fresh": "f"}
    assert state(spark, folder) == want
    after = names(f"{folder}/data")
    assert before <= after and 0 < len({p.split("part=")[1].split("/")[0] for p in after - before}) <= 3
    read = files.latest(spark, folder).inputFiles()
    assert sum("generation=0" in p for p in read) >= len(before) - 3
    assert not files.merge(second, folder, 1, 16)  # again
    assert names(folder) >= after and names(f"{folder}/data") == after and state(spark, folder) == want


def test_a_batch_that_broke_off_counts_only_when_it_is_done(spark, tmp_path):
    folder = str(tmp_path / "t")
    files.merge(spark.createDataFrame([(1, "a", "uploaded", "1")], EVENTS), folder, 0, 4)
    (tmp_path / "t" / "data" / "generation=1" / "part=0").mkdir(parents=True)
    (tmp_path / "t" / "manifest" / "version=1").mkdir(parents=True)  # no _SUCCESS
    assert state(spark, folder) == {"a": "1"}
    assert files.merge(spark.createDataFrame([(2, "a", "deleted", None)], EVENTS), folder, 1, 4)
    assert state(spark, folder) == {}
    assert not files.merge(spark.createDataFrame([], EVENTS), folder, 2, 4)


def test_a_stream_of_events_is_followed(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "t")
    for k, rows in enumerate([[(1, "a", "uploaded", "1"), (2, "b", "uploaded", "2")], [(3, "a", "deleted", None), (4, "c", "uploaded", "3")]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(source))
        files.follow(spark.readStream.schema(EVENTS).json(str(source)), folder, str(tmp_path / "check")).awaitTermination()
        assert len(files._versions(spark, folder)) == k + 1
    assert state(spark, folder) == {"b": "2", "c": "3"}
