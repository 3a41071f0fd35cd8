"""Shared helpers: staged tables in the shared folder, skew-proof lookups and vectorised word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup row that serves more than 1/HOT_SHARE of all rows is sent by broadcast; there are at most HOT_SHARE such rows.
HOT_SHARE = 1000
# The most ids that a broadcast may hold; beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000
# Spark's own setting: shuffle files go when the query that wrote them ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Spark's own setting: rows of whole texts go to Python in smaller batches than the 10,000 rows that it makes of its own accord.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode (tests) a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_own_shared_dir", None) or tempfile.mkdtemp(prefix="checkpoints-")
        spark._own_shared_dir = found
    return found.rstrip("/")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. The folder goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before, rows = spark.conf.get(SHUFFLES_GO, "false"), spark.conf.get(BATCH)
    spark.conf.set(SHUFFLES_GO, "true")  # what this write shuffled is not read again
    spark.conf.set(BATCH, min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
        spark.conf.set(BATCH, rows)
    atexit.register(drop_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before: the folder's owner cleans up
        return


def release() -> None:
    """What the allocators keep, and the tables of powers, go back to the system, as the worker process lives on."""
    import ctypes

    import pyarrow as pa

    _POW.update(pw=np.ones(1, np.uint64), ip=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidy(run):
    """Wrap a task's function of batches: memory is released when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run):
    """Wrap a function of one group's table: memory is released after each group."""

    def wrapped(table):
        try:
            return run(table)
        finally:
            release()

    return wrapped


def tidy_cogroup(run):
    def wrapped(key, left, right):
        try:
            return run(key, left, right)
        finally:
            release()

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def apart(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ...: whatever they are called, none meets a name of an operator's own."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of rows under their names in docs."""
    return rows.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def skew_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread: str) -> DataFrame:
    """Left-join rows to table on keys, where table has one row per key and says in `weight` how many rows ask for it.

    Keys with more than total/HOT_SHARE rows (at most HOT_SHARE of them) are looked up in a broadcast; only the rest is shuffled, and
    rows that are already served travel under a key of their own made from the column `spread`, so no task gets a hot key.
    """
    least = max(1, total // HOT_SHARE)
    values = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(weight) > least).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values])
    cold = table.where(F.col(weight) <= least).select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__cold_{c}") for c in values], F.lit(0).cast("long").alias("__away"))
    served = rows.join(F.broadcast(hot), keys, "left").withColumn("__own", F.when(F.col(f"__hot_{weight}").isNotNull(), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("__own") == F.col("__away")]
    both = served.join(cold, on, "left")
    return both.select(*rows.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])


# ---- vectorised words and shingles -------------------------------------------------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MI = np.uint64(pow(int(_M), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {"pw": np.ones(1, np.uint64), "ip": np.ones(1, np.uint64)}
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["pw"]) <= n:
        for k, m in (("pw", _M), ("ip", _MI)):
            a = np.full(max(n + 1, CHUNK + 2), m, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["pw"], _POW["ip"]


def chunks(column, most: int = CHUNK):
    """Cut an Arrow string column into (first row, bytes, offsets) runs of about `most` bytes; a row is never cut."""
    import pyarrow as pa

    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string()).fill_null("")
        _, off, data = part.buffers()
        off = np.frombuffer(off, np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield a, raw[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word [^\\x20\\x09-\\x0D]+ and the number of words of each row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # rows touch each other: words end there too
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    stop = np.flatnonzero(~space & (after | edge[1:])) + 1
    pw, ip = _powers(n)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * pw[:n], out=acc[1:])
    words = mix((acc[stop] - acc[start]) * ip[start] + (stop - start).astype(np.uint64))
    at = np.searchsorted(start, off)
    return words, np.diff(at)


_C = mix(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int):
    """For each row the sorted distinct hashes of its word shingles; a row with fewer words than width has its whole sequence as one."""
    words, counts = word_hashes(raw, off)
    long = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        long += words[k : k + len(long)] * _C[k]
    long = mix(long)
    a = 0
    for c in counts.tolist():
        if c >= width:
            yield np.unique(long[a : a + c - width + 1])
        elif c:
            yield mix((words[a : a + c] * _C[:c]).sum(keepdims=True, dtype=np.uint64) + np.array([c], np.uint64) * _C[63])
        else:
            yield np.zeros(0, np.uint64)
        a += c
