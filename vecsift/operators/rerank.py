"""k-reciprocal re-ranking, query by query: a fixed-size graph per query, so the cost of a query does not depend on the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import guards
from .graph import checkpointed
from .pairs import _units, by_blocks, least_cosines, neighbours, ranked


def _orders(d: np.ndarray):
    """(own scaled distances by row, order, the worse of the two places of each pair): what all parameters share."""
    n = len(d)
    top = d.max(0)
    o = (d / np.where(top > 0, top, 1.0)).T  # row i: node i's own scaled distances
    order = np.argsort(o, 1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n), (n, n)), 1)
    return o, order, np.maximum(place, place.T)


def _weights(o: np.ndarray, worst: np.ndarray, k1: int) -> np.ndarray:
    """What all k2 and lam of one k1 share."""
    half = int(np.round(k1 / 2))  # half to even
    whole, small = (worst <= k1).astype(float), (worst <= half).astype(float)
    grown = whole.astype(bool) & (3 * (whole @ small.T) > 2 * small.sum(1))  # counts, exact
    members = (whole + grown.astype(float) @ small) > 0
    w = np.where(members, np.exp(-o), 0.0)
    return w / w.sum(1, keepdims=True)


def _jaccard(weights: np.ndarray, order: np.ndarray, k2: int) -> np.ndarray:
    if k2 > 1:
        weights = weights[order[:, :k2]].mean(1)
    m = np.minimum(weights[0], weights).sum(1)
    return 1 - m / (2 - m)


def local_distances(d: np.ndarray, k1: int, k2: int, lam: float) -> np.ndarray:
    """d: distances of a small node set, node 0 the query -> blended distances of node 0 to all nodes.

    Columns are scaled by their maxima (0 by 0 is 0); node i's reciprocal set is what it and its k1 nearest have of each other, grown by
    the half-size sets of members that share over two thirds; weights exp(-d); averaged over the first k2; Jaccard by the sum of minima.
    """
    o, order, worst = _orders(d)
    return _jaccard(_weights(o, worst, k1), order, k2) * (1 - lam) + o[0] * lam


def _head(u: np.ndarray, s: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the query u with the scores s: its `top` nearest gallery rows, and node 0 and these to each other."""
    from .rankings import descending

    near = np.flatnonzero(~(s < np.partition(s, -top)[-top])) if top < len(s) else np.arange(len(s))  # with all ties of the last
    near = near[descending(s[near])][:top]
    nodes = np.concatenate([u[None], v[near]])
    d = 1 - np.clip(nodes @ nodes.T, -1, 1)
    np.fill_diagonal(d, 0.0)
    return near, d


def grid_metrics(queries: DataFrame, gallery: DataFrame, k1s, k2s, lams, top: int = 50) -> DataFrame:
    """k1, k2, lam, map_step: mean AP of every grid point under the market rule. Only the re-ranked heads differ between points: the part
    of a query's AP that lies behind its head is taken once, from the cosine ranking. One graph per query, orders shared by all
    parameters and weights by those of one k1; a task gives a sum for each point."""
    from .rankings import arrow_table, by_queries, descending, kept, scored

    schema = "k1 long, k2 long, lam double, ap double, n long"

    def solve(asked, mine):
        of, units, total, n = kept(asked, mine, "market"), _units(asked.column("v")), {}, 0
        for i, s in scored(asked, mine):
            ok, same = of(i)
            places = descending(s)
            eligible, right = ok[places], (ok & same)[places]
            if not right.any():
                continue
            at = np.flatnonzero(right)
            hit, rank = np.arange(1, len(at) + 1), np.cumsum(eligible)[at]
            behind, n = (hit / rank)[at >= top].sum(), n + 1
            near, d = _head(units[i], s, mine["v"], top)
            counted = np.sort(near[ok[near]])  # by key
            node = np.searchsorted(counted, near[ok[near]])
            node = np.flatnonzero(ok[near])[np.argsort(node)] + 1
            o, order, worst = _orders(d)
            for k1 in k1s:
                weights = _weights(o, worst, k1)
                for k2 in (k for k in k2s if k <= k1):
                    j = _jaccard(weights, order, k2)
                    for lam in lams:
                        first = same[counted][np.argsort((j * (1 - lam) + o[0] * lam)[node], kind="stable")]
                        r = np.flatnonzero(first) + 1
                        head = (np.arange(1, len(r) + 1) / r).sum()
                        total[k1, k2, lam] = total.get((k1, k2, lam), 0.0) + (head + behind) / len(at)
        if n:
            yield arrow_table(schema, zip(*((*p, ap, n) for p, ap in total.items()), strict=True))

    sums = by_queries(queries, gallery, ["id", "cam", "v"], solve, schema)
    return sums.groupBy("k1", "k2", "lam").agg((F.sum("ap") / F.sum("n")).alias("map_step"))


def best_point(points: DataFrame) -> DataFrame:
    """The row of the largest map_step; of equal ones the first in the order of the grid."""
    return points.orderBy(F.desc(F.round("map_step", 9)), "k1", "k2", "lam").limit(1)


def rerank(queries: DataFrame, gallery: DataFrame, k1: int = 6, k2: int = 3, lam: float = 0.3, top: int = 50) -> DataFrame:
    """(q, g, score): score = 1 - blended distance for the query's `top` nearest; the rest keep their cosine order below them. Rows leave
    their task as they are made."""
    from .rankings import by_queries, scored

    guards.positive("k1", k1), guards.positive("k2", k2), guards.share("lam", lam)

    def solve(asked, mine):
        import pyarrow as pa

        keys, units = asked.column("key").to_numpy(), _units(asked.column("v"))
        for i, s in scored(asked, mine):
            near, d = _head(units[i], s, mine["v"], top)
            new = local_distances(d, k1, k2, lam)[1:]
            score = s - 1 - new.max()
            score[near] = 1 - new
            yield pa.table({"q": pa.array(np.full(len(s), keys[i])), "g": pa.array(mine["key"]), "score": pa.array(score)})

    return by_queries(queries, gallery, ["v"], solve, "q long, g long, score double")


def joint_rerank(queries: DataFrame, gallery: DataFrame, k1: int, k2: int, lam: float, top: int) -> DataFrame:
    """(q, g, score, rank): each query's `top` best gallery rows by the graph over all queries and gallery rows (no key in both).

    The result of a query depends on all others, as local_distances over all rows with the query as node 0. A row is its own first
    neighbour; other ties go by key. Joins make the rows' weights, a few dozen each, from the lists of k1 nearest; blocks of the gallery
    then sum the minima for every pair, so a row that many share makes no pairs of its own.
    """
    import pyarrow as pa

    guards.positive("k1", k1), guards.positive("k2", k2), guards.share("lam", lam), guards.positive("top", top)
    rows = queries.select("key", "v").unionByName(gallery.select("key", "v"))
    half = int(np.round(k1 / 2))  # half to even
    near = checkpointed(neighbours(rows, k1).select("a", "b", "rank").unionByName(rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("rank"))))
    far = F.when(F.col("least") < 1, 1 - F.col("least")).otherwise(1.0)
    nodes = checkpointed(rows.join(least_cosines(rows), "key").select("key", "v", V.unit(F.col("v")).alias("u"), far.alias("far")))

    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rank").alias("back"))
    whole = near.join(back, ["a", "b"]).select("a", "b", F.greatest("rank", "back").alias("worst"))
    sets = checkpointed(whole.groupBy("a").agg(F.collect_list("b").alias("whole"), F.collect_list(F.when(F.col("worst") <= half, F.col("b"))).alias("small")))
    grown = sets.select("a", "whole", F.explode("whole").alias("b")).join(sets.select(F.col("a").alias("b"), "small"), "b")
    grown = grown.where(3 * F.size(F.array_intersect("small", "whole")) > 2 * F.size("small")).select("a", F.explode("small").alias("b"))
    members = sets.select("a", F.explode("whole").alias("b")).union(grown).distinct()
    d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("u"), F.col("u2")))))
    members = members.join(nodes.select(F.col("key").alias("a"), "u", "far"), "a").join(nodes.select(F.col("key").alias("b"), F.col("u").alias("u2")), "b")
    weights = members.select("a", F.struct("b", F.exp(-d / F.col("far")).alias("w")).alias("x")).groupBy("a").agg(F.collect_list("x").alias("x"), F.sum("x.w").alias("sum"))
    weights = weights.select("a", F.transform("x", lambda x: F.struct(x["b"].alias("b"), (x["w"] / F.col("sum")).alias("w"))).alias("x"))
    if k2 > 1:
        n = min(k2, rows.count())
        spread = near.where(F.col("rank") < k2).join(weights.withColumnRenamed("a", "b"), "b").select("a", F.inline("x").alias("m", "w"))
        weights = spread.groupBy("a", "m").agg((F.sum("w") / n).alias("w")).groupBy("a").agg(F.collect_list(F.struct(F.col("m").alias("b"), "w")).alias("x"))
    nodes = checkpointed(nodes.join(weights.withColumnRenamed("a", "key"), "key").select("key", "v", "far", F.col("x.b").alias("m"), F.col("x.w").alias("w")))

    def best(asked, mine):
        lists = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = lambda t: t.column("m").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        gm, owner = lists(mine, "m"), np.repeat(np.arange(len(mine)), sizes(mine))
        order = np.argsort(gm, kind="stable")
        gm, owner, gw = gm[order], owner[order], lists(mine, "w")[order]
        qm, qw, ends = lists(asked, "m"), lists(asked, "w"), np.cumsum(sizes(asked))
        lo = np.searchsorted(gm, qm)
        count = np.searchsorted(gm, qm, "right") - lo
        gk, qk, gv, qv, far = mine.column("key").to_numpy(), asked.column("key").to_numpy(), _units(mine.column("v")), _units(asked.column("v")), asked.column("far").to_numpy()
        out = []
        for a in range(0, len(qk), 512):
            d = 1 - np.clip(qv[a : a + 512] @ gv.T, -1, 1)
            for i in range(a, min(a + 512, len(qk))):
                part = slice(ends[i - 1] if i else 0, ends[i])
                c = count[part]
                at = np.repeat(lo[part] - np.cumsum(c) + c, c) + np.arange(c.sum())
                m = np.bincount(owner[at], np.minimum(np.repeat(qw[part], c), gw[at]), len(gk))
                score = 1 - ((1 - m / (2 - m)) * (1 - lam) + d[i - a] / far[i] * lam)
                first = np.argsort(-score, kind="stable")[:top]
                out.append((np.repeat(qk[i], len(first)), gk[first], score[first]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("q", "g", "score"), zip(*out, strict=True), strict=True)})

    of = lambda side: nodes.join(side.select("key"), "key", "left_semi")
    return ranked(by_blocks(of(queries), of(gallery), ["v", "far", "m", "w"], best, "q long, g long, score double"), top)
