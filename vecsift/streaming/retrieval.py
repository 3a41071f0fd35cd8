"""Streamed queries against a static gallery: a query's answer does not depend on the batch it comes in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import checkpointed
from ..operators.pairs import top_k


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpointed(spark.range(1))  # sets a temporary one
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def retrieve_stream(spark: SparkSession, queries: DataFrame, gallery: DataFrame, k: int, files: int = 4, per_trigger: int = 2) -> DataFrame:
    """Write the queries as files, read them as a stream, answer every micro-batch by the exact search and return what the sink holds.

    Batches are written under their batch id, so a batch that runs again after a failure replaces its own output.
    """
    folder = shared_folder(spark)
    queries.select("key", "v").repartition(files).write.parquet(f"{folder}/in")

    def answer(batch: DataFrame, batch_id: int) -> None:
        top_k(batch, gallery, k).select("q", "g", "rank").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream = spark.readStream.schema(queries.select("key", "v").schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("q", "g", "rank")
