"""Readers: detection rows, plain metadata, id lists, JSON reports, NumPy matrices and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

BOX_COLUMNS = ["image_id", "x", "y", "w", "h"]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with at least image_id, x, y, w, h (others are ignored) and row_no, the order of the file: the tie-break of everything later."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in BOX_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select("image_id", *[F.col(c).cast("int") for c in BOX_COLUMNS[1:]], F.monotonically_increasing_id().alias("row_no"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A list of ids between white space, with place."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(F.trim("value"), r"\s+")))
    return lines.where("col <> ''").select("line", "pos", F.col("col").alias("id"))


def same_order(left: DataFrame, right: DataFrame, key: str, place: str) -> DataFrame:
    """Rows whose place differs between two tables; empty where both have the same order."""
    return left.select(key, F.col(place).alias("a")).join(right.select(key, F.col(place).alias("b")), key, "full").where(~F.col("a").eqNullSafe(F.col("b")))


def read_report(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Values of nested keys ("a.b.c") of a JSON report, as text."""
    text = spark.read.text(path, wholetext=True)
    return text.select(*[F.get_json_object("value", f"$.{k}").alias(k.replace(".", "_")) for k in keys])


def file_scan(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, md5, sha256 of every file below."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def resolve_files(ids: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", "")) -> DataFrame:
    """id -> the first existing file in the order of the suffixes; an id that already ends in one is taken literally."""
    name = F.element_at(F.split("path", "/"), -1)
    have = files.select(F.col("path"), name.alias("name"))
    literal = F.col("id").rlike(r"\.(jpg|jpeg|png)$")
    tries = F.when(literal, F.array(F.col("id"))).otherwise(F.array(*[F.concat("id", F.lit(s)) for s in suffixes]))
    hit = ids.select("id", F.posexplode(tries).alias("place", "name")).join(have, "name")
    return ids.select("id").join(hit.groupBy("id").agg(F.min_by("path", "place").alias("path")), "id", "left")


class NpyDataSource(DataSource):
    """spark.read.format("npy").load(path): the rows of a two-dimensional .npy matrix as (row_no, v), read in slices."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return StructType([StructField("row_no", LongType()), StructField("v", ArrayType(DoubleType()))])

    def reader(self, schema):
        return _NpyReader(self.options["path"], int(self.options.get("rows", 10_000)))


class _NpyReader(DataSourceReader):
    def __init__(self, path, rows):
        self.path, self.rows = path, rows

    def partitions(self):
        import numpy as np

        n = len(np.load(self.path, mmap_mode="r", allow_pickle=False))
        return [InputPartition((a, min(a + self.rows, n))) for a in range(0, n, self.rows)]

    def read(self, partition):
        import numpy as np

        a, b = partition.value
        m = np.load(self.path, mmap_mode="r", allow_pickle=False)
        for k in range(a, b):
            yield k, m[k].astype(float).tolist()
