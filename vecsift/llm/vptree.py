"""Nearest neighbours by one vantage-point tree per shard.

Cosine is searched as the Euclidean distance of unit vectors, which is a metric. A tree node keeps a vantage point and the median distance
of its vectors to it; a query leaves out a half when the triangle inequality says that nothing there can beat its current k-th distance
tau divided by `factor`. factor 1 is exact search; a larger factor prunes more and may miss neighbours. Vectors of one direction (equal ones
and positive multiples) are one leaf entry with the smallest ids that can be returned, so a vector that a third of all rows share costs
no more than any other; entries are numbered by their smallest ids, and of equally near ones the smaller numbers are kept. A shard's task
builds its tree from its own rows; the queries stream past it. The found candidates are scored again on the original vectors, each pair
by the same sum. Scores that agree to 12 decimals are ties.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tidy

LEAF, SHARD_ROWS, QUERY_BLOCK = 256, 40_000, 512
FACTOR = 1.0
SAME = 12  # decimals
_PLACES = 22  # bits of an entry's number; the rest of 63 bits holds the cosine's distance from 1 to 2**-40
K, QUERY_EVERY = 5, 50


class VPTree:
    """Over unit vectors; search() works on a block of queries at a time."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.unit, self.leaf = unit, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, index: np.ndarray):
        todo_depth = math.ceil(math.log2(max(2, len(index) / self.leaf))) + 8
        return self._node(index, todo_depth)

    def _node(self, index, depth):
        if len(index) <= self.leaf or depth == 0:
            return index
        vantage = int(index[self.rng.integers(len(index))])
        d = self._distances(self.unit[vantage : vantage + 1], index)[0]
        order = np.argsort(d, kind="stable")
        half = len(index) // 2
        inner, outer = order[:half], order[half:]
        if d[order[0]] == d[order[-1]]:
            return index
        return vantage, float(d[inner].max()), float(d[outer].min()), self._node(index[inner], depth - 1), self._node(index[outer], depth - 1)

    def _distances(self, queries, index):
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (queries @ self.unit[index].T)))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> np.ndarray:
        """The entries nearest to each query, [queries, k], nearest first and equally near ones by number; -1 where there are fewer."""
        best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visited = 0
        self._visit(self.root, queries, np.arange(len(queries)), k, factor, best)
        return np.where(best == np.iinfo(np.int64).max, -1, best & ((1 << _PLACES) - 1))

    def _visit(self, node, queries, active, k, factor, best):
        if isinstance(node, np.ndarray):
            for a in range(0, len(node), 4096):
                part = node[a : a + 4096]
                self.visited += len(part) * len(active)
                far = np.rint((1.0 - queries[active] @ self.unit[part].T) * 2.0**40).astype(np.int64)
                keys = np.concatenate([best[active], (np.maximum(far, 0) << _PLACES) + part], 1)
                keys.partition(k - 1, 1)
                best[active] = np.sort(keys[:, :k], 1)
            return
        vantage, inner_most, outer_least, inner, outer = node
        d = self._distances(queries[active], np.array([vantage]))[:, 0]
        near = d <= (inner_most + outer_least) / 2
        for first in (True, False):  # the nearer half first, so that tau is small when the other is weighed
            for child, mine, gap in ((inner, near, d - inner_most), (outer, ~near, outer_least - d)):
                chosen = mine if first else ~mine
                tau = np.sqrt(2.0 * ((best[active, k - 1] >> _PLACES) + 1) / 2.0**40)
                chosen = chosen & (gap <= tau / factor + 1e-7)
                if chosen.any():
                    self._visit(child, queries, active[chosen], k, factor, best)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; scaled by the largest component against overflow, by powers of two so that nothing is rounded."""
    scale = lambda v: v * np.exp2(-np.floor(np.log2(np.abs(v).max(1, keepdims=True))))
    a, b = scale(a), scale(b)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: rows whose vector is there, finite in all components and not zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return v.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


class Shard:
    """The rows of one shard: entries of one direction each, numbered by their smallest ids, and the tree over them."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        unit = _unit(self.v)
        alike = np.ascontiguousarray(np.round(unit, SAME) + 0.0)
        _, first, group = np.unique(alike.view(np.dtype((np.void, alike.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(len(first))
        group = number[group]
        self.members = np.argsort(group, kind="stable")
        self.starts = np.searchsorted(group[self.members], np.arange(len(first) + 1))
        self.tree = VPTree(unit[np.sort(first)])

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        """(query id, row id, score) of each query's k nearest rows here, without its own id."""
        found = self.tree.search(_unit(q), min(k + 1, len(self.starts) - 1), factor)  # one more: the query itself may be among them
        r, c = np.nonzero(found >= 0)
        g = found[r, c]
        most = np.minimum(self.starts[g + 1] - self.starts[g], k + 1)  # of an entry, its smallest ids
        r = np.repeat(r, most)
        row = self.members[np.repeat(self.starts[g] - (np.cumsum(most) - most), most) + np.arange(int(most.sum()))]
        other = self.ids[row] != q_ids[r]
        r, row = r[other], row[other]
        score = exact_cosine(q[r], self.v[row]) if len(r) else np.zeros(0)
        o = np.lexsort((self.ids[row], -np.round(score, SAME), r))
        r, row, score = r[o], row[o], score[o]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        return q_ids[r[keep]], self.ids[row[keep]], score[keep]


def nearest(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = QUERY_EVERY, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `every` divides, its k nearest other rows by cosine.

    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different lengths do not meet. Ties go to
    the smaller id. With fewer than k candidates all are returned; an empty table gives an empty result. Rows that repeat an id with
    different vectors are candidates of their own, but never their own query's.
    """
    import pyarrow as pa

    rows = usable(vectors, id_col, vec_col).withColumn("dim", F.size("v"))
    total = rows.count()
    shards = max(2 * spark.sparkContext.defaultParallelism, math.ceil(total / min(shard_rows, 1 << _PLACES - 1)))
    dealt = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    queries = rows.where(F.col("id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")

    def search(batches):
        """Rows come by (dim, shard, asks): the rows of a shard, then its queries."""
        key, held, tree = None, [], None
        for b in batches:
            dim, shard, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "asks"))
            cut = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])]) if len(b) else []
            for a, e in zip(cut, np.r_[cut[1:], len(b)].astype(int), strict=True):
                if (dim[a], shard[a]) != key:
                    key, held, tree = (dim[a], shard[a]), [], None
                part = b.slice(a, e - a)
                ids, v = part.column("id").to_numpy(), _matrix(part.column("v"))
                if not asks[a]:
                    held.append((ids, v))
                    continue
                if tree is None and held:
                    tree, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for s in range(0, len(ids) if tree else 0, QUERY_BLOCK):
                    out = tree.nearest(ids[s : s + QUERY_BLOCK], v[s : s + QUERY_BLOCK], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    met = dealt.unionAll(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "asks")
    found = met.mapInArrow(tidy(search), "query_id long, vec_id long, score double").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", SAME).desc(), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
