"""Similarity graphs: components, cluster agreement, diffusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

WALKED = 512  # queries of a task


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share (spark.checkpoint.dir; a temporary one where it is unset)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """nodes (key), edges (a, b) -> (key, component): the smallest key that edges reach, itself for a lone node.

    Large-star and small-star rounds: every neighbourhood is reduced to its minimum, combined before the shuffle; the number of rounds
    grows with the logarithm of the longest path.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("key").join(e.select(F.col("u").alias("key"), F.col("v").alias("m")), "key", "left").select("key", F.coalesce("m", "key").alias("component"))


def cluster_agreement(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering against the truth, from the cells of the contingency table; and purity."""
    cell = rows.groupBy(pred, truth).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cell.agg(two("n").alias("tp"), F.sum("n").alias("total"))
    p = cell.groupBy(pred).agg(F.sum("n").alias("n"), F.max("n").alias("top")).agg(two("n").alias("pp"), F.sum("top").alias("pure"), F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))
    t = cell.groupBy(truth).agg(F.sum("n").alias("n")).agg(two("n").alias("tt"))
    x = both.crossJoin(p).crossJoin(t)  # one row each
    prec, rec = F.try_divide("tp", "pp"), F.try_divide("tp", "tt")
    return x.select(prec.alias("precision"), rec.alias("recall"), F.try_divide(2 * prec * rec, prec + rec).alias("f1"), F.try_divide("pure", "total").alias("purity"), "clusters", "largest")


def diffusion(queries: DataFrame, gallery: DataFrame, k: int = 10, top: int = 10, rounds: int = 25, alpha: float = 0.9, attach: int = 3) -> DataFrame:
    """(q, g, score, rank): each query's `top` best gallery rows by a random walk with restart, then by cosine, then by key.

    The walk is over the gallery's mutual-kNN graph, weights cos^3, symmetrically normalised, a fixed number of rounds; a query starts at
    its `attach` nearest, with their cos^3. Rows that the walk does not reach have score 0. A task walks for some hundreds of queries and
    holds the whole graph (at most k edges a row).
    """
    import pyarrow as pa

    from .pairs import mutual, neighbours, ranked, top_k

    cube = F.pow("sim", F.lit(3.0)).alias("w")
    e = mutual(neighbours(gallery, k)).where("sim > 0").select("a", "b", cube)
    e = checkpointed(e.union(e.select("b", "a", "w")).toDF("a", "b", "w"))
    d = e.groupBy("a").agg(F.sum("w").alias("d"))
    s = e.join(d, "a").join(d.toDF("b", "d2"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    near = checkpointed(top_k(queries, gallery, max(attach, top)))
    seeds = near.where((F.col("rank") <= attach) & (F.col("score") > 0)).select("q", "g", F.pow("score", F.lit(3.0)).alias("y"))
    parts = -(-queries.count() // WALKED) or 1
    seeds = seeds.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # to every part once

    def walk(seeds, edges):
        column = lambda t, c: t.column(c).to_numpy()
        nodes = np.unique(np.r_[column(seeds, "g"), column(edges, "a")])
        at, to, w = np.searchsorted(nodes, column(edges, "a")), np.searchsorted(nodes, column(edges, "b")), column(edges, "w")
        order = np.lexsort((to, at))
        at, to, w = at[order], to[order], w[order]
        slot = np.arange(len(at)) - np.searchsorted(at, at)  # a node has few edges: one of each node at a time
        steps = [(at[slot == n], to[slot == n], alpha * w[slot == n, None]) for n in range(slot.max() + 1 if len(slot) else 0)]
        asked, of = np.unique(column(seeds, "q"), return_inverse=True)
        place, y0 = np.searchsorted(nodes, column(seeds, "g")), column(seeds, "y")
        out = []
        for a in range(0, len(asked), 32):
            mine = (of >= a) & (of < a + 32)
            y = np.zeros((len(nodes), min(32, len(asked) - a)))
            y[place[mine], of[mine] - a] = y0[mine]
            f = y
            for _ in range(rounds):
                moved = (1 - alpha) * y
                for i, j, x in steps:
                    moved[i] += x * f[j]
                f = moved
            for c in range(f.shape[1]):
                reached = np.flatnonzero(f[:, c] > 0)
                x = f[reached, c]
                kept = x >= np.partition(x, len(x) - top)[len(x) - top] if len(x) > top else x > 0  # with all ties of the last
                out.append((np.full(kept.sum(), asked[a + c]), nodes[reached[kept]], x[kept]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, int), np.empty(0, int), np.empty(0)]
        return pa.table(dict(zip(("q", "g", "f"), map(pa.array, columns), strict=True)))

    f = seeds.groupBy("part").cogroup(s.groupBy("part")).applyInArrow(walk, "q long, g long, f double")
    side = lambda df, p: df.select(F.col("key").alias(p), V.unit(F.col("v")).alias(f"{p}_v"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("q_v"), F.col("g_v"))))
    f = f.join(side(queries, "q"), "q").join(side(gallery, "g"), "g").select("q", "g", "f", cos.alias("cos"))
    rest = near.select("q", "g", F.lit(0.0).alias("f"), F.col("score").alias("cos"))
    # a row of near that the walk reached has its f; the next rows by cosine are in near, as fewer than top stand before them
    both = f.unionByName(rest).groupBy("q", "g").agg(F.max("f").alias("f"), F.max("cos").alias("cos"))
    return ranked(both.withColumn("by", F.struct("f", "cos")), top, "by").select("q", "g", F.col("f").alias("score"), "rank")
