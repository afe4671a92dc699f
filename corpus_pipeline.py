"""A training corpus from `documents`: toxic and poor texts go, near copies go, benchmark passages go, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns that they were given.

A stage sets the session's `spark.sql.execution.arrow.maxBytesPerBatch` to
BATCH_BYTES and leaves it so, since its result is read later: an executor holds
a batch of texts several times, in the JVM and in each of its Python workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, near_copies, packing, quality, toxicity
from quillgraph.llm.queries import table, tokens

#: Most bytes of a batch of rows that goes to a Python worker; one larger row is a batch of its own.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """From now on batches are bounded by their bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic; the model learns from the labelled rows of `documents`. Null texts are scored as empty; an empty table stays empty."""
    bounded(spark)
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as poor; the model learns from the labelled rows of `documents`. Null texts are scored as empty; an empty table stays empty."""
    bounded(spark)
    return quality.keep_good(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the smallest doc_id. SimHash fingerprints within 2 bits link, as in op2; so do texts that are 0.8 alike in five-word shingles, which fingerprints miss. Null and empty texts are copies of each other."""
    bounded(spark)
    return near_copies.keep_first(docs, fingerprints=True)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that overlap a benchmark item. Null texts overlap none; without items nothing goes."""
    bounded(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row. Null texts have no tokens; an empty table gives an empty result."""
    bounded(spark)
    return packing.pack(docs, length=tokens())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: No stage could be written in SQL; the tests compare the kept rows with brute force over all pairs of texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each returns is written to the shared checkpoint folder and read again."""
    from uuid import uuid4

    from quillgraph.llm.durable import shared_folder

    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
