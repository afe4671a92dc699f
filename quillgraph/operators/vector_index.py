"""A vector index over a DataFrame: add, search, delete. Rows are (vec_id, embedding, metadata map)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .vector import every, top_k


@dataclass(frozen=True)
class VectorIndex:
    """Every change gives a new index; `rows` is what a caller writes."""

    rows: DataFrame
    width: int

    def add(self, rows: DataFrame) -> VectorIndex:
        """Rows with known ids replace the old ones; a vector of another width is an error."""
        checked = rows.withColumn("embedding", F.when(F.size("embedding") == self.width, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of this index have {self.width} places"))))
        return VectorIndex(self.rows.join(rows.select("vec_id").distinct(), "vec_id", "left_anti").unionByName(checked), self.width)

    def search(self, queries: DataFrame, k: int, least: float | None = None, where: Column | None = None) -> DataFrame:
        """The k nearest rows of each query (query_id, q); k = 0 ranks all rows, a negative k none."""
        rows = self.rows if where is None else self.rows.where(where)
        if k < 0:
            return top_k(queries.limit(0), rows, 1)
        if k == 0:
            return numbered(every(queries, rows, least), [F.desc("score"), F.col("vec_id")], "query_id")
        return top_k(queries, rows, k, least)

    def delete(self, metadata: dict[str, str]) -> tuple[VectorIndex, DataFrame]:
        """The index without the rows that have all of the given metadata, and n: how many those are."""
        hit = F.lit(True)
        for key, value in metadata.items():
            hit = hit & F.coalesce(F.col("metadata")[key] == value, F.lit(False))
        return VectorIndex(self.rows.where(~hit), self.width), self.rows.where(hit).agg(F.count(F.lit(1)).alias("n"))
