"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown on labelled rows; every path from a root to a node becomes a conjunctive rule over the statistics; lasso
logistic regression picks and weighs the rules; the rules are compiled into one Spark column expression that scores all rows.
The fit uses at most `MOST_LABELLED` labelled rows (those with the smallest hashes of their ids). The statistics of the rows to be scored
cover whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, chunks, documents, named, tidy, word_hashes

MOST_LABELLED = 20_000
TREES, DEPTH, LEAST_LEAF, PENALTY = 24, 3, 8, 2e-4

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?;:", "comma": b",", "bang": b"!", "bar": b"|", "symbol": b"*$%#&^~@<>{}[]\\=_+", "newline": b"\n", "space": b" \t\r\n\x0b\x0c"}
STATS = ["n_words", "word_bytes", *_CLASSES, "high", "symbol_runs", "repeats", "distinct", "second_repeats", "upper_words", "top_run"]


def _luts() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1), bool)
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars), k] = True
    table[128:, len(_CLASSES)] = True
    return table


def text_stats(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS per text. Shares are per byte, per word or per pair of words; an empty text is all zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(STATS)))
    size = np.diff(off)
    if not len(raw):
        return out
    luts = _luts()

    def per_text(flags):
        total = np.r_[0, np.cumsum(flags)]
        return total[off[1:]] - total[off[:-1]]

    words, counts = word_hashes(raw, off)
    bytes_, nw = np.maximum(size, 1), np.maximum(counts, 1)
    at = {c: k for k, c in enumerate(STATS)}
    shares = [per_text(luts[raw, k]) for k in range(luts.shape[1])]
    for name, c in zip([*_CLASSES, "high"], shares, strict=True):
        out[:, at[name]] = c / bytes_
    out[:, at["n_words"]] = np.log1p(counts)
    out[:, at["word_bytes"]] = (size - shares[list(_CLASSES).index("space")]) / nw
    within = np.ones(len(raw), bool)  # whether the next byte is of the same text
    within[off[1:][size > 0] - 1] = False
    odd = luts[raw, list(_CLASSES).index("symbol")] | luts[raw, list(_CLASSES).index("bang")]
    out[:, at["symbol_runs"]] = per_text(within & np.r_[odd[:-1] & odd[1:] & (raw[:-1] == raw[1:]), False]) / nw
    ends = np.r_[0, np.cumsum(counts)]
    doc = np.repeat(np.arange(n), counts)
    for name, back in (("repeats", 1), ("second_repeats", 2)):
        same = np.zeros(len(words), bool)
        same[back:] = (words[back:] == words[:-back]) & (doc[back:] == doc[:-back])
        out[:, at[name]] = np.bincount(doc, same, minlength=n) / nw
        if back == 1 and len(words):  # the longest run of one word
            place = np.arange(len(words))
            begin = np.maximum.accumulate(np.where(same, 0, place))
            longest = np.zeros(n)
            np.maximum.at(longest, doc, place - begin)
            out[:, at["top_run"]] = np.log1p(longest)
    order = np.lexsort((words, doc))
    first = np.ones(len(words), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out[:, at["distinct"]] = np.bincount(doc[order], first, minlength=n) / nw
    upper = luts[raw, 0]
    out[:, at["upper_words"]] = per_text(within & np.r_[upper[:-1] & upper[1:], False]) / nw
    return np.where(np.isfinite(out) & (ends[-1] >= 0), out, 0.0)


def with_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and STATS of every row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for first, raw, off in chunks(b.column("body")):
                x = text_stats(raw, off)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(x)), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATS))]], ["id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(tidy(run), "id long, " + ", ".join(f"{s} double" for s in STATS))


# ---- the fit, on the driver, over at most MOST_LABELLED rows -----------------------------------------------------------------


def _grow(x, bins, edges, g, h, depth, path, rules):
    """One regression tree by second-order gain; returns the leaf values of the rows and adds each node's path to rules."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2 * LEAST_LEAF:
        return value
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for k in range(bins.shape[1]):
        m = len(edges[k]) + 1
        gs, hs, cs = (np.cumsum(np.bincount(bins[:, k], w, minlength=m))[:-1] for w in (g, h, np.ones(len(g))))
        ok = (cs >= LEAST_LEAF) & (len(g) - cs >= LEAST_LEAF)
        gain = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole, 0)
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), k, int(gain.argmax()))
    _, k, c = best
    if k is None:
        return value
    left = bins[:, k] <= c
    for side, above in ((left, False), (~left, True)):
        step = (*path, (k, float(edges[k][c]), above))
        rules.add(step)
        value[side] = _grow(x[side], bins[side], edges, g[side], h[side], depth - 1, step, rules)
    return value


def holds(rule, x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), bool)
    for k, edge, above in rule:
        found &= (x[:, k] > edge) == above
    return found


def fit_rules(x: np.ndarray, y: np.ndarray):
    """-> (intercept, [(weight, rule)]): the rules with a weight after the lasso. One class only: its rate and no rules."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 4 * LEAST_LEAF or y.min() == y.max():
        return base, []
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    rules: set = set()
    f = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        f = f + 0.5 * _grow(x, bins, edges, y - p, p * (1 - p), DEPTH, (), rules)
    rules = sorted(rules)
    a = np.stack([holds(r, x) for r in rules], 1).astype(float)
    mid, scale = a.mean(0), a.std(0) + 1e-9
    a = (a - mid) / scale
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(y))
    w = z = np.zeros(len(rules))
    b = base
    t = 1.0
    for _ in range(300):  # accelerated proximal steps
        p = 1 / (1 + np.exp(-np.clip(a @ z + b, -30, 30)))
        b -= 4.0 * (p - y).mean()
        new = z - step * (a.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    w = w / scale
    return float(b - (w * mid).sum()), [(float(v), r) for v, r in zip(w, rules, strict=True) if v]


def compile_rules(intercept: float, rules, prefix: str = "") -> Column:
    """The score as one column expression over STATS."""
    logit = F.lit(intercept)
    for weight, rule in rules:
        test = F.lit(True)
        for k, edge, above in rule:
            c = F.col(prefix + STATS[k])
            test = test & (c > F.lit(edge) if above else c <= F.lit(edge))
        logit = logit + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-logit))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """At most `most` (doc_id, y): rows outside the held-out fold, by the smallest hashes of their ids; ids with two different labels are left out."""
    y = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("y")).where("l_id IS NOT NULL AND y IS NOT NULL").where(~held_out("l_id", modulus, remainder))
    y = y.groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top AND y IN (0, 1)")
    return y.orderBy(F.xxhash64("l_id"), "l_id").limit(most).select("l_id", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    ids = labelled_ids(labels, "quality", 3, 1, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))  # at most `most` ids
    stats = with_stats(rows, "doc_id", "text").join(F.broadcast(ids), F.col("id") == F.col("l_id"))
    data = np.array([tuple(r) for r in stats.orderBy("l_id").limit(2 * most).select("y", *STATS).collect()], float).reshape(-1, len(STATS) + 1)
    return fit_rules(data[:, 1:], data[:, 0])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have all-zero statistics and are scored like any other. Without labels of both classes the score is the smoothed
    rate of label 1. A null id is not held out. Repeated rows get equal scores; extra columns are not read; an empty table stays empty.
    """
    model = fit_quality(docs, labels)
    scored = with_stats(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), compile_rules(*model).alias("score"))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier accepts, with all columns (the pipeline's stage); statistics travel beside the text."""
    import pyarrow as pa

    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    place, rows = docs.columns.index("text"), apart(docs)

    def run(batches):
        for b in batches:
            for first, raw, off in chunks(b.column(place)):
                x = text_stats(raw, off)
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(x)).columns, *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATS))]], [*b.schema.names, *STATS])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    wide = rows.mapInArrow(tidy(run), schema + ", " + ", ".join(f"{s} double" for s in STATS))
    return named(wide.where(compile_rules(*model) >= 0.5), docs)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
