"""The document graph that the relational tables stand for.

An order is a sentence, the smallest supplier of its lines its document, the
customer's nation its section and the nation's region the section above; a
part is an entity that the order's lines mention; customers are tied to parts
by relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Tables


def sentences(t: Tables) -> DataFrame:
    doc = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("doc_id"))
    rows = t.orders.join(doc, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) - 1).alias("idx")
    return rows.select(F.col("o_orderkey").alias("sid"), "doc_id", F.col("c_nationkey").cast("long").alias("section_id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("score"), idx)


def mentions(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("sid"), F.col("l_partkey").alias("eid")).distinct()


def relations(t: Tables) -> DataFrame:
    """(src, dst, w): parts of one order number after another, a sparse graph over parts."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return line.withColumn("dst", nxt).where("dst is not null and dst <> l_partkey").groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


SENTENCES = """sent AS (
  SELECT o.o_orderkey AS sid, d.doc_id, CAST(c.c_nationkey AS BIGINT) AS section_id, o.o_custkey AS cust, o.o_totalprice AS score,
         ROW_NUMBER() OVER (PARTITION BY d.doc_id ORDER BY o.o_orderkey) - 1 AS idx
  FROM orders o JOIN (SELECT l_orderkey, MIN(l_suppkey) AS doc_id FROM lineitem GROUP BY l_orderkey) d ON d.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey)"""
MENTIONS = "mention AS (SELECT DISTINCT l_orderkey AS sid, l_partkey AS eid FROM lineitem)"
RELATIONS = """rel AS (
  SELECT src, dst, CAST(COUNT(*) AS DOUBLE) AS w FROM (SELECT l_partkey AS src, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) x
  WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst)"""
BOTH = "arc AS (SELECT src, dst FROM rel UNION SELECT dst AS src, src AS dst FROM rel)"
