"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

1. Directory: hashes of the texts are counted. A bucket is a prefix of the hash; where it holds more than `capacity` distinct hashes the
   directory doubles, one more bit of the hash, until each bucket fits or the hash has no more bits.
2. Owners: each owner task has a range of the hash space, whole buckets of about equal bytes. Texts travel to the owner of their bucket
   once; a text whose hash a large part of all rows share is first combined where it lies, so a copy group of any size is one row a task.
3. An owner groups the rows of a bucket by hash and compares the texts' bytes; texts of one hash form a chain. The entries are written to
   the shared files.
4. Each row finds its bucket in the directory and its entry in the chain of its hash, by the SHA-256 of its text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, apart, documents, named, skew_lookup, stage

CAPACITY = 1 << 14  # distinct hashes of a bucket; more only beyond 2**MOST_BITS buckets, which bounds the directory
MOST_BITS = 18
OWNER_BYTES, MOST_OWNERS = 16 << 20, 32_768  # texts that an owner groups, more where there would be over MOST_OWNERS


def _slot(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits)


def directory(counted: DataFrame, capacity: int, owners: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """counted: h, size -> levels (bits, [(slot, bucket, owner)]), each for the slots that the level before left open.

    A bucket is named by the smallest hash of its range. The first level has about 4 slots for each bucket that is needed; only slots that
    are overfull by themselves get a further level with 8 more bits.
    """
    distinct = counted.count()
    bits = min(MOST_BITS + 2, max(1, int(np.ceil(np.log2(max(1.0, distinct / capacity)))) + 2))
    levels, leaves, open_slots, before = [], [], None, 0
    while True:
        rows = counted.withColumn("slot", _slot(bits))
        if open_slots is not None:
            rows = rows.join(F.broadcast(open_slots), _slot(before) == F.col("open"), "left_semi")
        held = {r[0]: (r[1], r[2]) for r in rows.groupBy("slot").agg(F.count(F.lit(1)), F.sum("size")).collect()}  # of at most 2**bits slots
        loads, size = {bits: {k: v[0] for k, v in held.items()}}, {k: v[1] for k, v in held.items()}
        for d in range(bits - 1, before - 1, -1):
            loads[d] = {}
            for k, v in loads[d + 1].items():
                loads[d][k >> 1] = loads[d].get(k >> 1, 0) + v
        found, over = [], []
        for k in sorted(held):
            depth = next((d for d in range(before, bits + 1) if loads[d][k >> (bits - d)] <= capacity), None)
            if depth is None and bits < 63:
                over.append(k)
            else:
                depth = bits if depth is None else depth
                bucket = (k >> (bits - depth)) << (64 - depth)
                found.append((k, bucket, size[k]))
        levels.append((bits, found))
        leaves += [(bucket, n) for _, bucket, n in found]
        if not over:
            break
        open_slots = counted.sparkSession.createDataFrame([(k,) for k in over], "open long")  # at most distinct / capacity
        before, bits = bits, min(63, bits + 8)
    # ranges of whole buckets, in the order of the hashes
    total, at, owner = sum(n for _, n in leaves) or 1, 0, {}
    for bucket, n in sorted(leaves):
        owner.setdefault(bucket, min(owners - 1, at * owners // total))
        at += n
    return [(b, [(k, bucket - (1 << 64) if bucket >> 63 else bucket, owner[bucket]) for k, bucket, _ in found]) for b, found in levels]


def in_bucket(rows: DataFrame, levels) -> DataFrame:
    """rows: h, ... -> with bucket and owner, looked up in the directory (at most 2**(MOST_BITS + 2) rows are sent)."""
    spark, names = rows.sparkSession, rows.columns
    for k, (bits, found) in enumerate(levels):
        table = spark.createDataFrame(found, f"slot_{k} long, bucket_{k} long, owner_{k} int")
        rows = rows.withColumn(f"slot_{k}", _slot(bits)).join(F.broadcast(table), f"slot_{k}", "left")
    pick = lambda c: F.coalesce(*[F.col(f"{c}_{k}") for k in range(len(levels))])
    return rows.select(*names, pick("bucket").alias("bucket"), pick("owner").alias("owner"))


def _hashed(rows: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("h", hash_of(F.col("body")).cast("long"))


def build_index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64):
    """(entries, directory, rows of docs). One entry per distinct text, kept on shared files: bucket, h, chain (its place among the texts of
    one hash), sha, keep_id, group_size."""
    rows = _hashed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")), hash_of)
    counted = stage(spark, rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("body")).cast("long").alias("size")), "hashes")
    total, distinct, size = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    floor = 2 * spark.sparkContext.defaultParallelism
    least = max(1, total // HOT_SHARE)
    owners = max(floor, min(MOST_OWNERS, -(-size // OWNER_BYTES)))
    levels = directory(counted.select("h", (F.col("size") * F.when(F.col("n") > least, 1).otherwise(F.col("n"))).alias("size")), max(1, min(capacity, distinct // (4 * floor)), distinct >> MOST_BITS), owners)
    hot = counted.where(F.col("n") > least).select("h", F.lit(True).alias("hot"))  # at most HOT_SHARE rows
    marked = rows.join(F.broadcast(hot), "h", "left")
    lone = marked.where("hot IS NULL").select("h", "body", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    many = marked.where("hot").groupBy("h", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    dealt = in_bucket(lone.unionByName(many), levels).repartitionById(owners, F.col("owner"))
    entries = dealt.groupBy("owner", "bucket", "h", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = entries.select("owner", "bucket", "h", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")
    chain = Window.partitionBy("owner", "bucket", "h").orderBy("sha")
    entries = entries.withColumn("chain", F.row_number().over(chain)).select("bucket", "h", "chain", "sha", "keep_id", "group_size")
    return stage(spark, entries, "exact-index"), levels, total


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest id stays (a null id loses to any other). Rows that repeat an id
    with the same text all carry that id and are marked kept when it is the largest. An empty table gives an empty result. Other columns
    are not read, whatever their names. capacity and hash_of steer the index, never the result.
    """
    index, levels, total = build_index(spark, docs, id_col, text_col, capacity, hash_of)
    rows = _hashed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")), hash_of)
    rows = in_bucket(rows.select("doc_id", "h", F.sha2("body", 256).alias("sha")), levels).drop("owner")
    found = skew_lookup(rows, index.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"], "group_size", total, "doc_id")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(spark: SparkSession, docs: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names (the pipeline's stage).

    Only groups of two or more are looked up, in the chains of their buckets. They go by broadcast while there are at most
    `most_broadcast` of them (about 100 bytes each), beyond that by the skew-proof shuffled lookup. Rows that repeat both the id and the
    text that stay are the same record and all stay.
    """
    index, levels, total = build_index(spark, docs)
    copied = index.where("group_size > 1").select("bucket", "h", "sha", "keep_id", "group_size")
    body = F.coalesce(F.col(f"c{docs.columns.index('text')}"), F.lit(""))
    rows = apart(docs).withColumns({"id": F.col(f"c{docs.columns.index('doc_id')}"), "h": F.xxhash64(body), "sha": F.sha2(body, 256)})
    rows = in_bucket(rows, levels).drop("owner")
    if copied.count() <= most_broadcast:
        found = rows.join(F.broadcast(copied), ["bucket", "h", "sha"], "left")
    else:
        found = skew_lookup(rows, copied, ["bucket", "h", "sha"], "group_size", total, "id")
    return named(found.where(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))), docs)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
