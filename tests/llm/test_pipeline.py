"""The corpus pipeline, stage by stage, against what its operators say."""

import pytest
from conftest import SMALL

import corpus_pipeline
from quillgraph.llm import decontaminate, quality, toxicity
from test_near_copies import slow_near
from test_near_duplicates import slow_components


def test_registered():
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{i}_") for n in q) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "decontaminate", "packing"]


def test_run(spark):
    docs, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    out = corpus_pipeline.run(spark, SMALL).collect()
    tox = {r["doc_id"] for r in toxicity.classify(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    bad = {r["doc_id"] for r in quality.classify(docs, quality.fit(docs, labels)).where("predicted = 0").collect()}
    left = docs.toPandas()
    left = left[~left["doc_id"].isin(tox | bad)]
    ids, texts = left["doc_id"].tolist(), left["text"].tolist()
    own = slow_components(texts, slow_near)  # all pairs of texts
    keep = {min(i for i, o in zip(ids, own, strict=True) if o == k) for k in set(own)}
    dirty = {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(keep - dirty)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_survive_odd_rows(spark, k):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "some plain text that is fine to keep here", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, SMALL)
    assert out.columns == docs.columns and out.count() <= 4
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SMALL).count() == 0


def test_batches_of_texts_are_bounded_by_bytes(spark, tmp_path):
    """The packing stage took an executor over its limit: batches were 10,000 rows, however long the texts."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(600).repartition(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))
        packed = corpus_pipeline.packing_stage(spark, docs, "")

        @F.arrow_udf("long")
        def size(texts: pa.Array) -> pa.Array:
            return pa.array([sum(len(t) for t in texts.to_pylist())] * len(texts), pa.int64())

        most = docs.select(size("text").alias("n")).agg(F.max("n")).first()[0]
        assert 0 < most <= corpus_pipeline.BATCH_BYTES + 2 * 20_000  # 12 MB in all
        assert packed.count() == 600 and packed.select("n_tokens").distinct().count() == 1
    finally:
        spark.conf.set(key, before)
