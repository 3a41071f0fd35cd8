"""Fixed-format results, the run manifest and atomic publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def submission_rows(ranking: DataFrame, k: int = 10) -> DataFrame:
    """q, g1..gk: one wide row per query."""
    rows = ranking.where(F.col("rank") <= k).groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("gs"))
    return rows.select("q", *[F.try_element_at("gs", F.lit(i)).alias(f"g{i}") for i in range(1, k + 1)])


def candidate_rows(pairs: DataFrame, threshold: float) -> DataFrame:
    """q, g, confidence with six decimals: all pairs at or over the threshold (compared unrounded); a refused query has no rows."""
    return pairs.where(F.col("score") >= threshold).select("q", "g", F.format_string("%.6f", "score").alias("confidence"))


def embedding_rows(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Queries first, then the gallery, as float32, in the order of (part, key)."""
    a = queries.select(F.lit(0).alias("part"), "key", F.col("v").cast("array<float>").alias("v"))
    return a.unionByName(gallery.select(F.lit(1).alias("part"), "key", F.col("v").cast("array<float>").alias("v"))).orderBy("part", "key")


def publish(spark: SparkSession, tables: dict[str, tuple[DataFrame, dict]], path: str) -> str:
    """Write several CSV results beside the target and publish all by one rename. An existing target is never overwritten."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(hadoop)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    for name, (df, options) in tables.items():
        df.write.options(**options).csv(f"{staging}/{name}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not publish {path}")
    return path


def manifest(queries: DataFrame, gallery: DataFrame, candidates: DataFrame, params: dict) -> DataFrame:
    """One row of JSON: counts, parameters, and an order-free content digest of the gallery."""
    spark = queries.sparkSession
    counts = queries.agg(F.count(F.lit(1)).alias("queries")).crossJoin(gallery.agg(F.count(F.lit(1)).alias("gallery"), F.hex(F.expr("bit_xor(xxhash64(key, v))")).alias("gallery_digest"))).crossJoin(candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("q").alias("answered")))
    settled = spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string")
    return counts.crossJoin(settled).select(F.to_json(F.struct("queries", "gallery", "gallery_digest", "candidates", "answered", "params")).alias("run_info"))  # one row each
