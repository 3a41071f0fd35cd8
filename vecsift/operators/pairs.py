"""The pair table and what is read off it: scores, ranks, top-k, thresholds and refusal."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import guards

BLOCK, ASKED = 4096, 16_384  # gallery rows and queries of one product


def protocol(spark: SparkSession, sf_dir: str, second: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queries, gallery) of the derived retrieval protocol: key, id, cam, frame, v. second: the other model's (reversed) vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = V.doubles("embedding")
    e = e.select(F.col("vec_id").alias("key"), F.col("label").alias("id"), F.expr("(vec_id div 5) % 4").alias("cam"), F.expr("vec_id div 10").alias("frame"), (F.reverse(v) if second else v).alias("v"))
    return e.where("key % 5 = 0"), e.where("key % 5 <> 0 AND id < 8")


def _units(column) -> np.ndarray:
    column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def dealt(queries: DataFrame, gallery: DataFrame, columns: list[str]) -> DataFrame:
    """key, columns, asks, b, c: every block of queries (c) meets every block of the gallery (b) once; neither side is held whole."""
    n, m = max(1, math.ceil(gallery.count() / BLOCK)), max(1, math.ceil(queries.count() / ASKED))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")
    q = queries.select("key", *columns, F.lit(True).alias("asks"), own(m).alias("c")).withColumn("b", every(n))
    g = gallery.select("key", *columns, F.lit(False).alias("asks"), own(n).alias("b")).withColumn("c", every(m))
    return g.unionByName(q)


def score_pairs(queries: DataFrame, gallery: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(q, g, score) by cosine, all pairs, each block's k best per query (ties by key) or those of at least `least`: Arrow blocks and one
    matrix product each; what is not asked for never leaves the product."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def product(block):
        mine, asked = block.filter(pc.invert(block.column("asks"))), block.filter(block.column("asks"))
        if not len(mine) or not len(asked):
            return pa.table({"q": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        gk, qk = mine.column("key").to_numpy(), asked.column("key").to_numpy()
        order = np.argsort(gk, kind="stable")
        gk, gv, qv = gk[order], _units(mine.column("v"))[order], _units(asked.column("v"))
        out = []
        for a in range(0, len(qk), 512):
            s = np.clip(qv[a : a + 512] @ gv.T, -1, 1)
            if least is not None:
                r, c = np.nonzero(s >= least)
                out.append((qk[a + r], gk[c], s[r, c]))
                continue
            if k and k < len(gk):
                best = np.argsort(-s, 1, kind="stable")[:, :k]
            else:
                best = np.broadcast_to(np.arange(len(gk)), s.shape)
            out.append((np.repeat(qk[a : a + 512], best.shape[1]), gk[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("q", "g", "score"), zip(*out, strict=True), strict=True)})

    return dealt(queries, gallery, ["v"]).groupBy("b", "c").applyInArrow(product, "q long, g long, score double")


def by_blocks(queries: DataFrame, gallery: DataFrame, columns: list[str], product, schema: str) -> DataFrame:
    """product(asked, mine), an Arrow table of the schema (long and double), of each gallery block (mine, by key) and block of queries."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(block):
        mine, asked = block.filter(pc.invert(block.column("asks"))), block.filter(block.column("asks"))
        if not len(mine) or not len(asked):
            return pa.table({c: pa.array([], pa.int64() if kind == "long" else pa.float64()) for c, kind in (x.split() for x in schema.split(", "))})
        return product(asked, mine.sort_by("key"))

    return dealt(queries, gallery, columns).groupBy("b", "c").applyInArrow(run, schema)


def least_cosines(rows: DataFrame) -> DataFrame:
    """(key, least): each row's smallest cosine with any row."""
    import pyarrow as pa

    def least(asked, mine):
        gv, qv = _units(mine.column("v")), _units(asked.column("v"))
        low = [np.clip(qv[a : a + 512] @ gv.T, -1, 1).min(1) for a in range(0, len(qv), 512)]
        return pa.table({"key": asked.column("key"), "least": pa.array(np.concatenate(low))})

    return by_blocks(rows, rows, ["v"], least, "key long, least double").groupBy("key").agg(F.min("least").alias("least"))


def pair_statistics(queries: DataFrame, gallery: DataFrame, least: float) -> DataFrame:
    """q, twins (rows of other identities with a cosine of at least `least`), mate (the largest cosine with one's own identity) of each query."""
    import pyarrow as pa

    def count(asked, mine):
        gv, qv = _units(mine.column("v")), _units(asked.column("v"))
        ids = lambda t: t.column("id").to_numpy(zero_copy_only=False).astype(float)  # noqa: E731  NULL as NaN
        gi, qi = ids(mine), ids(asked)
        twins, mates = [], []
        for a in range(0, len(qv), 512):
            s = np.clip(qv[a : a + 512] @ gv.T, -1, 1)
            same = qi[a : a + 512, None] == gi
            other = ~same & ~np.isnan(qi[a : a + 512, None]) & ~np.isnan(gi)
            twins.append((other & ~(s < least)).sum(1))
            mates.append(np.where(same, s, -np.inf).max(1))
        mate = np.concatenate(mates)
        return pa.table({"q": asked.column("key"), "twins": pa.array(np.concatenate(twins)), "mate": pa.array(mate, mask=mate == -np.inf)})

    return by_blocks(queries, gallery, ["id", "v"], count, "q long, twins long, mate double").groupBy("q").agg(F.sum("twins").alias("twins"), F.max("mate").alias("mate"))


def second_moments(rows: DataFrame, of) -> DataFrame:
    """pos, m, n: the sum of x x' over the rows, x = of(unit vectors), an entry each, and the number of rows; one matrix leaves a task."""
    import pyarrow as pa

    def total(batches):
        n, m = 0, 0.0
        for b in batches:
            if len(b):
                x = of(_units(pa.chunked_array([b.column("v")])))
                n, m = n + len(b), m + x.T @ x
        if n:
            yield pa.record_batch({"pos": pa.array(np.arange(m.size)), "m": pa.array(m.ravel()), "n": pa.array(np.full(m.size, n))})

    return rows.select("v").mapInArrow(total, "pos long, m double, n long").groupBy("pos").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))


def mean_squared_difference(queries: DataFrame, gallery: DataFrame, other) -> DataFrame:
    """One row: mean, over all pairs, of the squared difference of the query's cosines with the gallery's unit vector u and with other(u).

    The difference is q . (u - other(u)); the sum of its squares is the product of both sides' second moments, so no pair is made.
    """
    both = second_moments(queries, lambda u: u).join(second_moments(gallery, lambda u: u - other(u)).toDF("pos", "m2", "n2"), "pos")
    return both.agg((F.sum(F.col("m") * F.col("m2")) / (F.max("n") * F.max("n2"))).alias("mean"))


def labelled_pairs(queries: DataFrame, gallery: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """q, g, score with ids, cameras and frames of both sides."""
    s = score_pairs(queries, gallery) if scores is None else scores
    side = lambda df, p: df.select(F.col("key").alias(p), F.col("id").alias(f"{p}_id"), F.col("cam").alias(f"{p}_cam"), F.col("frame").alias(f"{p}_frame"))
    return s.join(side(gallery, "g"), "g").join(side(queries, "q"), "q")


def ranked(pairs: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """rank by score descending, then key ascending; k keeps the best (Spark limits the groups before the shuffle)."""
    r = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(score), F.asc("g"))))
    return r.where(F.col("rank") <= k) if k else r


def top_k(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Exact search: partial top-k of each gallery block, then the merge."""
    return ranked(score_pairs(queries, gallery, k), k)


def accepted(pairs: DataFrame, threshold: float) -> DataFrame:
    """score >= threshold, unrounded."""
    return pairs.where(F.col("score") >= threshold)


def search(queries: DataFrame, gallery: DataFrame, k: int, threshold: float) -> DataFrame:
    """One row per query: refusal, best_confidence (also when refused), n_accepted and the accepted keys in order.

    The threshold is applied after the top-k; queries that meet an empty gallery are refused with a null confidence.
    """
    guards.positive("k", k), guards.finite("threshold", threshold)
    t = top_k(queries, gallery, k)
    ok = F.col("score") >= threshold
    per = t.groupBy("q").agg(F.max("score").alias("best_confidence"), F.count_if(ok).alias("n_accepted"), F.sort_array(F.collect_list(F.when(ok, F.struct("rank", "g")))).alias("hits"))
    out = queries.select(F.col("key").alias("q")).join(per, "q", "left")
    n = F.coalesce("n_accepted", F.lit(0))
    return out.select("q", (n == 0).alias("refusal"), "best_confidence", n.cast("long").alias("n_accepted"), F.coalesce(F.array_join(F.transform("hits", lambda h: h["g"].cast("string")), ","), F.lit("")).alias("accepted"))


def camera_keep(policy: str) -> Column:
    """The eligible pairs: market drops the same identity under the same camera, all_same_camera all of the same camera, none nothing."""
    same = F.col("q_cam") == F.col("g_cam")
    return {"market": ~((F.col("q_id") == F.col("g_id")) & same), "all_same_camera": ~same, "none": F.lit(True)}[policy]


def similarity_join(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b, cosine >= threshold: block products of the rows with themselves."""
    s = score_pairs(rows, rows, least=threshold)
    return s.where("q < g").select(F.col("q").alias("a"), F.col("g").alias("b"), F.col("score").alias("sim"))


def band_join(left: DataFrame, right: DataFrame, columns: list[str], width: int, key: str = "key") -> DataFrame:
    """(a, b) with |left.c - right.c| <= width in all columns. The first two columns are bucketed, so the join has a hash key:
    a row meets the buckets around its own, and the rest is a filter."""
    keyed = columns[:2]
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    l = left.select(F.col(key).alias("a"), *[F.col(c).alias(f"l_{c}") for c in columns], *[bucket(c).alias(f"bucket_{c}") for c in keyed])
    r = right.select(F.col(key).alias("b"), *[F.col(c).alias(f"r_{c}") for c in columns])
    for c in keyed:
        near = F.floor(F.col(f"r_{c}") / F.lit(width)).cast("long")
        r = r.withColumn(f"bucket_{c}", F.explode(F.array(near - 1, near, near + 1)))
    out = l.join(r, [f"bucket_{c}" for c in keyed])
    for c in columns:
        out = out.where(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= width)
    return out.select("a", "b")


def iou_join(left: DataFrame, right: DataFrame, least: float, widest: float, tallest: float, key: str = "key") -> DataFrame:
    """(a, b, iou) of boxes x, y, w, h with an intersection over union of at least `least`, whatever their corners.

    Such boxes' corners differ by at most (1 - least) of the larger width and height (`widest` and `tallest` at most), and their widths by
    the factor `least`: buckets of x, y and the logarithm of w are the hash key, and a box meets the buckets around its own.
    """
    dx, dy, ratio = max(1e-9, (1 - least) * widest), max(1e-9, (1 - least) * tallest), -math.log(least)
    cells = {"i": lambda p: F.floor(F.col(f"{p}_x") / dx), "j": lambda p: F.floor(F.col(f"{p}_y") / dy), "k": lambda p: F.floor(F.log(F.col(f"{p}_w").cast("double")) / ratio)}
    side = lambda df, p: df.where("w > 0 AND h > 0").select(F.col(key).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in "xywh"])
    l, r = side(left, "a"), side(right, "b")
    for name, cell in cells.items():
        l = l.withColumn(name, cell("a").cast("long"))
        near = cell("b").cast("long")
        r = r.withColumn(name, F.explode(F.array(near - 1, near, near + 1)))
    box = lambda p: tuple(F.col(f"{p}_{c}") for c in "xywh")
    return l.join(r, list(cells)).withColumn("iou", V.iou(box("a"), box("b"))).where(F.col("iou") >= least).select("a", "b", "iou")


def neighbours(rows: DataFrame, k: int) -> DataFrame:
    """(a, b, sim, rank): each row's k nearest others."""
    s = score_pairs(rows, rows, k + 1).where("q <> g")
    return ranked(s, k).select(F.col("q").alias("a"), F.col("g").alias("b"), F.col("score").alias("sim"), "rank")


def mutual(knn: DataFrame) -> DataFrame:
    """Edges a < b that are in each other's lists."""
    other = knn.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return knn.join(other, ["a", "b"]).where("a < b").select("a", "b", "sim")
