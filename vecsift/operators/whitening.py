"""Whitening learnt from same-identity pairs across cameras."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(pairs, mean outer product of differences) over pairs of one id and different cameras, without making the pairs.

    The sum over a set of n rows of all pairs' outer products is n * sum(x x') - s s', and pairs across cameras are those of the id less
    those within its cameras. So each row's x x' weighs its id's rows less its cell's, and s s' is taken once for each id and cell, from
    sums that the shuffle combines. Every task gives one D x D matrix, which are summed by the thousand before the driver gets one.
    """
    import pyarrow as pa

    d = len(rows.select("v").first()[0])
    v = [F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(d)]
    cells = rows.groupBy("id", "cam").agg(F.count(F.lit(1)).alias("n"), *v)
    ids = cells.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(d)])
    pack = lambda df, sign: df.select(F.lit(float(sign)).alias("w"), F.array(*[f"s{k}" for k in range(d)]).alias("v"))
    weights = cells.select("id", "cam", "n").join(ids.select("id", F.col("n").alias("all")), "id")
    weighed = rows.select("id", "cam", "v").join(weights, ["id", "cam"]).select((F.col("all") - F.col("n")).cast("double").alias("w"), "v")
    terms = weighed.unionByName(pack(ids, -1)).unionByName(pack(cells, 1))

    def gram(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)
            total += (x * b.column("w").to_numpy()[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    part = terms.mapInArrow(gram, "m array<double>").withColumn("part", F.spark_partition_id() % 32)

    def add(table):
        return pa.table({"m": pa.array([np.sum([np.array(m) for m in table.column("m").to_pylist()], 0)], pa.list_(pa.float64()))})

    sums = part.groupBy("part").applyInArrow(add, "m array<double>").collect()  # at most 32 matrices
    squares = cells.groupBy("id").agg((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
    n = int(squares / 2)
    return n, np.sum([np.array(r["m"]) for r in sums], 0).reshape(d, d) / max(n, 1)


def fit(rows: DataFrame, shrink: float = 0.1) -> tuple[list[float], list[list[float]]]:
    """(mean, matrix): the inverse Cholesky factor of (1 - shrink) C + shrink tr(C)/D I, on the driver (D x D)."""
    _, c = moments(rows)
    d = len(c)
    c = (1 - shrink) * c + shrink * np.trace(c) / d * np.eye(d)
    mean = [r[0] for r in rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").select("m").collect()]
    return mean, np.linalg.inv(np.linalg.cholesky(c)).tolist()


def whiten(rows: DataFrame, mean: list[float], matrix: list[list[float]]) -> DataFrame:
    """v -> unit(matrix (v - mean)): one matrix product per Arrow batch."""
    import pyarrow as pa

    m, p = np.array(mean), np.array(matrix)
    place = rows.columns.index("v")

    def run(batches):
        for b in batches:
            v = b.column(place)
            x = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) - m) @ p.T
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat if k == place else c for k, c in enumerate(b.columns)], rows_names)

    rows_names = rows.columns
    return rows.mapInArrow(run, rows.schema)
