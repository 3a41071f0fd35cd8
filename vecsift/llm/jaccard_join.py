"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence matrix, exact at its threshold.

1. Each text becomes a row of the incidence matrix: its distinct word shingles as 64-bit hashes. Equal rows form one class; the rest
   works on classes, so copies never meet each other.
2. Size-derived bounds on columns: in one global order of the shingles, two classes can only link when they share at least l shingles
   among the first n - ceil(t*n) + l of each (the l-th shingle they share has at least t*n - l shared ones after it). With l = 1 + n/10,
   only those columns are multiplied to find partners, and a class that shares fewer of them than its smallest partner's l is out. The order puts frequent shingles last: those
   that repeat within runs of documents are counted, and the `HEAVY` most frequent are told apart. That steers speed only: any order is
   exact.
3. Column blocks (ranges of shingle hashes, packed) are multiplied in bulk. A column's classes are named after the smallest of them; that
   name is a row block, and all classes which share any such column with it belong to the block. Each pair that shares a column thus meets.
4. Row blocks are cut into tiles of at most about TILE classes, and every pair of tiles is one product X.Y' that accumulates whole
   overlap counts; pairs under the size bound on the union are discarded. A tile gives back a spanning forest of its links and the
   number of links of each class (a pair that meets in several blocks counts in the first), not the pairs.
5. Components of the forests give the classes' labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, HOT_SHARE, chunks, documents, mix, shingle_sets, skew_lookup, stage, tidy, tidy_group
from .components import components

WIDTH, PERCENT = 5, 75
HEAVY = 1_000_000
RUN = 2_000_000
TILE = 1500
BROADCAST_PLACES = 200_000
COLUMN_BLOCK = 500_000


def prefix_length(n: int, percent: int) -> int:
    """Columns of a set of n that are multiplied: all that can hold its first 1 + n/10 shingles in common with a linked set."""
    return min(n, n - -(-n * percent // 100) + 1 + n // 10)


def _fingerprint(s: np.ndarray) -> int:
    return int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).view(np.int64)) if len(s) else 0


def _sets(batches, width):
    for b in batches:
        ids = b.column("id")
        for first, raw, off in chunks(b.column("body")):
            for k, s in enumerate(shingle_sets(raw, off, width)):
                yield ids[first + k].as_py(), s


def _grouped(items, most, make):
    rows, held = [], 0
    for size, row in items:
        rows.append(row)
        held += size
        if held >= most:
            yield make(rows)
            rows, held = [], 0
    if rows:
        yield make(rows)


def _describe(width: int):
    """Rows of both kinds: (id, size of its set, fingerprint), and (shingle, how often it repeats within a run of about RUN shingles)."""
    import pyarrow as pa

    def make(rows):
        ids, sets = zip(*rows, strict=True)
        cells = np.concatenate(sets)
        cells.sort()
        edge = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        times = np.diff(np.r_[edge, len(cells)])
        often, times = cells[edge[times > 1]].view(np.int64), times[times > 1]
        n, m = len(ids), len(often)
        blank, away = pa.nulls(n, pa.int64()), pa.nulls(m, pa.int64())
        two = lambda a, b: pa.concat_arrays([a, b])
        columns = [two(pa.array(ids, pa.int64()), away), two(pa.array([len(x) for x in sets], pa.int64()), away), two(pa.array([_fingerprint(x) for x in sets], pa.int64()), away)]
        return pa.RecordBatch.from_arrays([*columns, two(blank, pa.array(often, pa.int64())), two(blank, pa.array(times, pa.int64()))], ["id", "n", "fp", "s", "times"])

    def run(batches):
        yield from _grouped(((len(x) + 1, (i, x)) for i, x in _sets(batches, width)), RUN, make)

    return run


def _prefixes(width: int, percent: int, heavy, hot, blocks: int):
    """Packed cells (shingle, class) of the columns that the size bound leaves, by column block."""
    import pyarrow as pa

    def run(batches):
        order, weight = heavy
        hot_fp, hot_id = hot

        def cells():
            for i, s in _sets(batches, width):
                fp = _fingerprint(s)
                k = int(np.searchsorted(hot_fp, fp))
                if not len(s) or (k < len(hot_fp) and hot_fp[k] == fp and hot_id[k] != i):
                    continue  # of a class with very many copies, one row stands for all
                size = len(s)
                p = prefix_length(size, percent)
                if len(order):
                    at = np.minimum(np.searchsorted(order, s), len(order) - 1)
                    rank = np.where(order[at] == s, weight[at], 0)
                    s = s[np.lexsort((s, rank))[:p]]
                else:
                    s = s[:p]
                yield p, (s, fp, size)

        def make(rows):
            sets, fps, sizes = zip(*rows, strict=True)
            s, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(x) for x in sets])
            fps, sizes = np.array(fps, np.int64), np.array(sizes, np.int64)
            block = (s % np.uint64(blocks)).astype(np.int64)
            o = np.argsort(block, kind="stable")
            s, who, block = s[o], who[o], block[o]
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            out = []
            for a, b in zip(cut, np.r_[cut[1:], len(s)], strict=True):
                here, index = np.unique(who[a:b], return_inverse=True)
                out.append((int(block[a]), s[a:b].tobytes(), index.astype(np.uint32).tobytes(), fps[here].tobytes(), sizes[here].astype(np.uint32).tobytes()))
            kinds = (pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "s", "who", "fp", "n"])

        yield from _grouped(cells(), 1_000_000, make)

    return run


def _multiply_columns(percent: int, buckets: int):
    """One column block: (class, the smallest class of its column, number of such columns), over columns of two classes or more, packed by
    buckets of classes.

    A column's classes are first parted where, in the order of their sizes, one is too small to link with the next.
    """
    import pyarrow as pa

    def run(table):
        s, fp, n = [], [], []
        for x in table.to_pylist():
            who = np.frombuffer(x["who"], np.uint32)
            s.append(np.frombuffer(x["s"], np.uint64))
            fp.append(np.frombuffer(x["fp"], np.int64)[who])
            n.append(np.frombuffer(x["n"], np.uint32)[who].astype(np.int64))
        s, fp, n = np.concatenate(s), np.concatenate(fp), np.concatenate(n)
        o = np.argsort(s, kind="stable")
        s, fp, n = s[o], fp[o], n[o]
        new = np.r_[True, s[1:] != s[:-1]]
        lone = new & np.r_[new[1:], True]
        s, fp, n = s[~lone], fp[~lone], n[~lone]
        if not len(s):
            return packed([])
        o = np.lexsort((fp, n, s))
        s, fp, n = s[o], fp[o], n[o]
        once = np.r_[True, (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])]
        s, fp, n = s[once], fp[once], n[once]
        new = np.r_[True, (s[1:] != s[:-1]) | (100 * n[:-1] < percent * n[1:])]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lead = np.minimum.reduceat(fp, starts)[group]
        shared = np.diff(np.r_[starts, len(s)])[group] > 1
        pairs, times = np.unique(np.stack([fp[shared], lead[shared]], 1), axis=0, return_counts=True) if shared.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        if not len(pairs):
            return packed([])
        bucket = (mix(np.ascontiguousarray(pairs[:, 0]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, bucket[o][1:] != bucket[o][:-1]])
        parts = [o[a:b] for a, b in zip(cut, np.r_[cut[1:], len(o)], strict=True)]
        return packed([(int(bucket[k[0]]), pairs[k, 0].tobytes(), pairs[k, 1].tobytes(), times[k].astype(np.int64).tobytes()) for k in parts])

    def packed(rows):
        kinds = (pa.int64(), *[pa.binary()] * 3)
        return pa.table({c: pa.array([x[j] for x in rows], k) for j, (c, k) in enumerate(zip(("bucket", "fp", "r", "times"), kinds, strict=True))})

    return run


def _sum_columns(table):
    """One bucket of classes: (class, row block, columns that they share), summed over the column blocks."""
    import pyarrow as pa

    fp, r, times = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("fp", "r", "times"))
    o = np.lexsort((r, fp))
    fp, r = fp[o], r[o]
    first = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (r[1:] != r[:-1])])
    return pa.table({"fp": pa.array(fp[first]), "r": pa.array(r[first]), "times": pa.array(np.add.reduceat(times[o], first))})


def _emit_sets(width: int):
    import pyarrow as pa

    def run(batches):
        rows = ((len(s), (i, _fingerprint(s), s.tobytes())) for i, s in _sets(batches, width))
        make = lambda r: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "fp", "cells"])
        yield from _grouped(rows, 1_000_000, make)

    return run


def _multiply_tile(percent: int):
    import pyarrow as pa

    def tile(r, i, j, fps, weights, own, cells, others):
        """Links of one pair of tiles: rows (fp, to, links)."""
        m = len(fps)
        sets = [np.frombuffer(c, np.uint64) for c in cells]
        sizes = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(m), sizes)
        order = np.argsort(np.concatenate(sets), kind="stable")
        flat, row = np.concatenate(sets)[order], row[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        col = np.cumsum(new) - 1
        often = np.bincount(col) > 1
        keep = often[col]
        row, col = row[keep], (np.cumsum(often) - 1)[col[keep]]
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j) if i != j else left
        overlap = np.zeros((len(left), len(right)), np.float32)
        place = np.full((2, m), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        step = 2048
        for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            lo, hi = np.searchsorted(col, [a, a + step])
            rr, cc = row[lo:hi], col[lo:hi] - a
            x = np.zeros((len(left), step), np.float32)
            p = place[0, rr]
            x[p[p >= 0], cc[p >= 0]] = 1
            if i == j:
                y = x
            else:
                y = np.zeros((len(right), step), np.float32)
                q = place[1, rr]
                y[q[q >= 0], cc[q >= 0]] = 1
            overlap += x @ y.T
        inter = overlap.astype(np.int64)
        linked = 100 * inter >= percent * (sizes[left][:, None] + sizes[right][None, :] - inter)
        if i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        # the forest: each class takes the smallest label that its links reach
        full = np.zeros((m, m), bool)
        full[np.ix_(left, right)] = linked
        full |= full.T
        label, old = np.arange(m), None
        while old is None or (label != old).any():
            old = label
            label = np.minimum(label, np.where(full, label[None, :], m).min(1))
            label = label[label]
        # a pair that also meets in an earlier block counts there; blocks that only one class of the tile has cannot matter
        who = np.repeat(np.arange(m), [len(o) for o in others])
        block = np.concatenate([np.array(o, np.int64) for o in others])
        who, block = who[block < r], block[block < r]
        _, block, held = np.unique(block, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(held > 1)
        for a in range(0, len(shared), step):
            part = shared[a : a + step]
            k = np.searchsorted(part, block)
            hit = part[np.minimum(k, len(part) - 1)] == block
            inc = np.zeros((m, len(part)), np.float32)
            inc[who[hit], k[hit]] = 1
            full &= (inc @ inc.T) == 0
        links = full.astype(np.float64) @ weights
        for k in range(m):
            if label[k] != k or links[k]:
                yield int(fps[k]), int(fps[label[k]]), int(links[k])

    def run(batches):
        """Rows arrive sorted by (r, i, j): each run of one key is a tile."""
        held, key = [], None

        def flush():
            if key is not None and len(held) > 1:
                yield from tile(*key, np.array([h[0] for h in held]), np.array([h[1] for h in held], float), np.array([h[2] for h in held]), [h[3] for h in held], [h[4] for h in held])

        def rows():
            nonlocal held, key
            for b in batches:
                for r, i, j, *rest in zip(*(b.column(c).to_pylist() for c in ("r", "i", "j", "fp", "copies", "own", "cells", "rs")), strict=True):
                    if (r, i, j) != key:
                        yield from flush()
                        held, key = [], (r, i, j)
                    if not held or held[-1][0] != rest[0]:  # a repeated row adds nothing
                        held.append(rest)
            yield from flush()

        yield from _grouped(((1, x) for x in rows()), 20_000, lambda r: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*r, strict=True)], ["fp", "to", "links"]))

    return run


def jaccard_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links.

    Two rows link when 100*|A and B| >= percent*|A or B| of their sets of `width`-word shingles. Null and empty texts have no shingles
    and link with nothing; texts shorter than width words are one shingle. component_id is the smallest id that links reach, n_links the
    number of other rows linked. Copies (and repeated rows) link with each other. Rows with a null id are left out. Extra columns are
    not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).where("id IS NOT NULL")
    described = stage(spark, rows.mapInArrow(tidy(_describe(width)), "id long, n long, fp long, s long, times long"), "described")
    frequent = described.where("s IS NOT NULL").groupBy("s").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "s").limit(HEAVY)
    frequent = frequent.toArrow()  # at most HEAVY rows
    order, weight = frequent.column("s").to_numpy().view(np.uint64), np.log2(frequent.column("times").to_numpy()).astype(np.int8)
    o = np.argsort(order)
    described = described.where("s IS NULL").select("id", "n", "fp")
    classes = stage(spark, described.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    total, cells = described.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + F.ceil(F.col("n") / 10) + 1), F.lit(0))).first()

    hot = classes.where(F.col("copies") > max(1, total // HOT_SHARE)).select("fp", "rep").orderBy("fp").collect()  # at most HOT_SHARE rows
    hot = np.array([r[0] for r in hot], np.int64), np.array([r[1] for r in hot], np.int64)

    blocks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(cells / COLUMN_BLOCK))
    packed = rows.mapInArrow(tidy(_prefixes(width, percent, (order[o], weight[o]), hot, blocks)), "block long, s binary, who binary, fp binary, n binary")
    met = packed.repartition(blocks, "block").groupBy("block").applyInArrow(tidy_group(_multiply_columns(percent, blocks)), "bucket long, fp binary, r binary, times binary")
    met = met.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(tidy_group(_sum_columns), "fp long, r long, times long")
    met = stage(spark, met, "met")
    enough = F.col("shared") >= F.expr(f"1 + (ceil(n * {percent} / 100) div 10)")
    likely = met.groupBy("fp").agg(F.sum("times").alias("shared")).join(classes, "fp").where(enough).select("fp", "rep", "copies")
    met = met.select("fp", "r").join(likely, "fp")

    # row blocks of two or more classes, cut into tiles; a class has at most its own prefix columns of row blocks
    met = stage(spark, met, "likely")
    n_met = met.count()
    per_block = met.groupBy("r").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    placed = skew_lookup(met, per_block, ["r"], "m", n_met, "fp").where("m IS NOT NULL").withColumn("t", F.ceil(F.col("m") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", "r"), F.col("t")).cast("int"))
    places = placed.groupBy("fp", "rep", "copies").agg(F.sort_array(F.collect_list(F.struct("r", "t", "own"))).alias("at"))
    places = stage(spark, places.withColumnRenamed("rep", "id"), "places")
    if places.count() <= BROADCAST_PLACES:
        matrix = rows.join(F.broadcast(places.select("id")), "id", "left_semi").mapInArrow(tidy(_emit_sets(width)), "id long, fp long, cells binary").join(F.broadcast(places), ["id", "fp"])
    else:
        matrix = rows.join(places.select("id"), "id", "left_semi").mapInArrow(tidy(_emit_sets(width)), "id long, fp long, cells binary").join(places, ["id", "fp"])
    tiles = matrix.select("fp", "copies", "cells", F.col("at.r").alias("rs"), F.explode("at").alias("p")).select("fp", "copies", "cells", "rs", "p.r", "p.own", F.explode(F.sequence(F.lit(0), F.col("p.t") - 1)).alias("o"))
    tiles = tiles.select("r", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "fp", "copies", "own", "cells", "rs")
    linked = tiles.repartition("r", "i", "j").sortWithinPartitions("r", "i", "j", "fp").mapInArrow(tidy(_multiply_tile(percent)), "fp long, to long, links long")
    linked = stage(spark, linked, "linked")

    rep = classes.select("fp", "rep")
    edges = linked.where("fp != to").select("fp", "to").join(rep, "fp").withColumnRenamed("rep", "a").join(rep.toDF("to", "b"), "to").select("a", "b")
    label = components(spark, edges)
    degree = linked.groupBy("fp").agg(F.sum("links").alias("links"))
    found = classes.join(label, classes["rep"] == label["node"], "left").join(degree, "fp", "left")
    found = found.select("fp", F.coalesce("label", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = skew_lookup(described.withColumn("fp", F.when(F.col("n") > 0, F.col("fp"))), found, ["fp"], "copies", total, "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all columns (the pipeline's stage)."""
    found = jaccard_classes(spark, docs)
    gone = stage(spark, found.where("doc_id != component_id").select("doc_id"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark, documents(spark, sf_dir))
