"""A gallery kept as a Parquet table: create, fill, count, look up, and a seed that never overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import table_diff


class Gallery:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def recreate(self, rows: DataFrame) -> int:
        """Replace the table and check the number of rows written."""
        want = rows.count()
        rows.write.mode("overwrite").parquet(self.path)
        if self.count() != want:
            raise RuntimeError("the gallery does not hold all rows")
        return want

    def upsert(self, rows: DataFrame, key: str = "key") -> None:
        """New and changed rows by key: written beside and then swapped in by the overwrite of a checkpointed union."""
        from ..operators.graph import checkpointed

        old = self.read().join(rows.select(key), key, "left_anti")
        checkpointed(old.unionByName(rows)).write.mode("overwrite").parquet(self.path)

    def seed(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """Create the table once; where it exists, only compare: the rows that differ (none if it is the same content)."""
        try:
            old = self.read()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            self.recreate(rows)
            old = self.read()
        return table_diff(old, rows, key)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.read().count()

    def boxes(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys, "key", "left_semi").select("key", *[c for c in ("x", "y", "w", "h") if c in self.read().columns])

    def search(self, queries: DataFrame, k: int, threshold: float) -> DataFrame:
        from ..operators.pairs import search

        if not self.count():
            raise RuntimeError("the gallery is empty")
        return search(queries, self.read().withColumn("v", F.col("v").cast("array<double>")), k, threshold)
