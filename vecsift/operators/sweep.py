"""Threshold sweeps and the choice of an operating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: str, columns: list[str], grain: int = 4096) -> DataFrame:
    """rows (one for each value of `by`) with the columns summed over all rows with at least that value.

    Ranges of 1/grain of `by` are summed apart and the sums of the higher ranges added, so no task orders all rows; the one ordered window
    over ranges has a row each (at most 2 * grain + 1 of a cosine).
    """
    cut = rows.withColumn("range", F.floor(F.col(by) * grain).cast("long"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("range").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    sums = sums.select("range", *[F.coalesce(F.sum(f"all_{c}").over(above), F.lit(0)).alias(f"all_{c}") for c in columns])
    within = Window.partitionBy("range").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(sums, "range")
    return out.select(*[(F.sum(c).over(within) + F.col(f"all_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def sweep(events: DataFrame, prior: float | None = None) -> DataFrame:
    """events: score, correct, unknown (one per query) -> a row per distinct score, and one above all scores (threshold NULL, accept nothing).

    precision, recall, f1 and tnr at `score >= threshold`; prior re-weighs unknown queries to that share of all.
    """
    base = events.select("score", "correct", "unknown")
    n = base.agg(F.count_if(~F.col("unknown")).alias("known"), F.count_if(F.expr("unknown")).alias("n_unknown"))
    g = base.where("score IS NOT NULL").groupBy(F.col("score").alias("threshold")).agg(F.count_if(F.expr("correct")).alias("t"), F.count_if(~F.col("correct") & ~F.col("unknown")).alias("fk"), F.count_if(F.expr("unknown")).alias("fu"))
    c = running(g, "threshold", ["t", "fk", "fu"])
    nothing = n.select(F.lit(None).cast("double").alias("threshold"), *[F.lit(0).cast("long").alias(x) for x in ("t", "fk", "fu")])
    c = c.unionByName(nothing).crossJoin(F.broadcast(n))  # n is one row
    weight: Column = F.lit(1.0) if prior is None else F.lit(prior) / (1 - prior) * F.col("known") / F.nullif("n_unknown", F.lit(0))
    fp = F.col("fk") + weight * F.col("fu")
    fn = F.col("known") - F.col("t")
    return c.select("threshold", F.col("t").alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("n_unknown") - F.col("fu")).alias("tn_unknown"), F.col("fu").alias("fp_unknown"), F.try_divide(F.col("t"), F.col("t") + fp).alias("precision"), F.try_divide(F.col("t"), F.col("known")).alias("recall"), F.try_divide(2 * F.col("t"), 2 * F.col("t") + fp + fn).alias("f1"), F.try_divide(F.col("n_unknown") - F.col("fu"), F.col("n_unknown")).alias("tnr"))


def f1_under_prior(p: float, recall: Column, false_rate: Column) -> Column:
    """2(1-p)r / ((1-p)(1+r) + p f): F1 when a share p of queries is unknown."""
    return F.try_divide(2 * (1 - p) * recall, (1 - p) * (1 + recall) + p * false_rate)


def choose(curve: DataFrame, how: str, target: float = 0.9) -> DataFrame:
    """One row: best_f1, balanced (max min(tnr, recall)), robust (max min(tnr, f1 at priors .10 .25 .40), then f1, then tnr) or
    target_tnr (lowest threshold that reaches it). Ties: the highest threshold."""
    c = curve.where("threshold IS NOT NULL")
    if how == "best_f1":
        order = [F.desc("f1")]
    elif how == "balanced":
        order = [F.desc(F.least("tnr", "recall"))]
    elif how == "robust":
        f = F.col("fp_unknown") / (F.col("fp_unknown") + F.col("tn_unknown"))
        order = [F.desc(F.least("tnr", *[f1_under_prior(p, F.col("recall"), f) for p in (0.10, 0.25, 0.40)])), F.desc("f1"), F.desc("tnr")]
    elif how == "target_tnr":
        return c.where(F.col("tnr") >= target).orderBy(F.asc("threshold")).limit(1)
    else:
        raise ValueError(how)
    return c.orderBy(*order, F.desc("threshold")).limit(1)


def best_f1(curve: DataFrame, tie: str) -> DataFrame:
    """One row of a precision-recall curve: the largest F1; of equal ones the first when scanned upwards from the lowest threshold
    (tie "lowest"), or the highest threshold (tie "highest")."""
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    scored = curve.where("threshold IS NOT NULL").withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    return scored.orderBy(F.desc(F.round("f1", 9)), {"lowest": F.asc("threshold"), "highest": F.desc("threshold")}[tie]).limit(1)


def prior_transfer(events: DataFrame, priors: tuple[float, ...]) -> DataFrame:
    """chosen_at, used_at, threshold, f1, regret: the best threshold at one share of unknown queries, judged at another, and what it loses
    against the best one there. One sweep; the priors are columns of it."""
    c = sweep(events).where("threshold IS NOT NULL")
    n = events.agg(F.count_if(~F.col("unknown")).alias("n_known"), F.count_if(F.expr("unknown")).alias("n_open"))
    weight = F.col("prior") / (1 - F.col("prior")) * F.col("n_known") / F.nullif("n_open", F.lit(0))
    at = c.crossJoin(F.broadcast(n)).select("*", F.explode(F.array(*[F.lit(p) for p in priors])).alias("prior"))
    at = at.withColumn("f1_at", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + (F.col("fp") - F.col("fp_unknown")) + weight * F.col("fp_unknown") + F.col("fn"))).select("threshold", "prior", "f1_at")
    best = at.groupBy("prior").agg(F.max(F.struct(F.round("f1_at", 9).alias("f"), "threshold", "f1_at")).alias("b")).select(F.col("prior").alias("p"), F.col("b.threshold").alias("t"), F.col("b.f1_at").alias("f1_best"))
    chosen, there = best.select(F.col("p").alias("chosen_at"), F.col("t").alias("cut")), best.select(F.col("p").alias("prior"), "f1_best")  # a row per prior
    return at.join(F.broadcast(chosen), F.col("threshold") == F.col("cut")).join(F.broadcast(there), "prior").select("chosen_at", F.col("prior").alias("used_at"), "threshold", F.col("f1_at").alias("f1"), (F.col("f1_best") - F.col("f1_at")).alias("regret"))
