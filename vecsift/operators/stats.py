"""Resampling and multiple comparisons. Draws come from MD5 of (seed, draw, row): any partitioning and any engine makes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A uniform number in [0, 1) from a key."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(*key: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(f"({k})::VARCHAR" for k in key) + "), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def poisson1(u: Column) -> Column:
    """A Poisson(1) count by inversion: bootstrap multiplicities that need no row numbers, so each draw is one pass of weighted sums."""
    out, p, total = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 12):
        out = out + (u >= total).cast("int")
        p /= k
        total += p
    return out


def poisson1_sql(u: str) -> str:
    out, p, total = [], 0.36787944117144233, 0.36787944117144233
    for k in range(1, 12):
        out.append(f"({u} >= {total!r})::INT")
        p /= k
        total += p
    return " + ".join(out)


def with_draws(units: DataFrame, by: list[str], draws: int, run: int = 100) -> DataFrame:
    """units with draw, 1 to draws, dealt to tasks by unit and run of draws: units are often so few that all would be drawn in one task."""
    runs = units.select("*", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // run))).alias("run"))
    runs = runs.repartition(2 * units.sparkSession.sparkContext.defaultParallelism, *by, "run")
    return runs.select(*units.columns, F.explode(F.sequence(F.col("run") * run + 1, F.least(F.col("run") * run + run, F.lit(draws)))).alias("draw"))


def multiplicities(rows: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """by, draw, k: how many times each draw takes the rows of each distinct `by`, of a key of seed, the first of `by`, draw and the rest; k > 0."""
    drawn = with_draws(rows.select(*by).distinct(), by, draws)
    u = uniform(F.lit(seed), F.col(by[0]), F.col("draw"), *map(F.col, by[1:]))
    return drawn.withColumn("k", poisson1(u)).where("k > 0")


def sign_test(rows: DataFrame, value: str) -> DataFrame:
    """n_plus, n_minus, p_sign: the two-sided binomial p of at most min(n_plus, n_minus) signs of the rarer kind; zeros do not count."""
    n = rows.agg(F.count_if(F.col(value) > 0).alias("n_plus"), F.count_if(F.col(value) < 0).alias("n_minus"))
    total, m = F.col("n_plus") + F.col("n_minus"), F.least("n_plus", "n_minus")
    start = F.struct((-total * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, k: F.struct((a["log"] + F.log(((total - k).cast("double")) / (k + 1))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), m), start, step, lambda a: a["sum"])
    return n.select("n_plus", "n_minus", F.when(total > 0, F.least(F.lit(1.0), 2 * tail)).alias("p_sign"))


def bootstrap_mean(rows: DataFrame, value: str, key: str, draws: int = 4000, seed: int = 1, cluster: str | None = None, level: float = 0.95) -> DataFrame:
    """mean, lo, hi, p_two_sided of the mean of value, by the Poisson bootstrap; cluster resamples whole groups (ratio of sums)."""
    name = cluster or key
    sums = rows.groupBy(F.col(name).alias("unit")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = with_draws(sums, ["unit"], draws)
    times = poisson1(uniform(F.lit(seed), F.col("draw"), F.col("unit")))
    each = drawn.withColumn("k", times).groupBy("draw").agg(F.try_divide(F.sum(F.col("k") * F.col("s")), F.sum(F.col("k") * F.col("n"))).alias("m"))
    a = (1 - level) / 2
    out = each.agg(F.expr(f"percentile(m, {a})").alias("lo"), F.expr(f"percentile(m, {1 - a})").alias("hi"), F.count_if(F.expr("m <= 0")).alias("below"), F.count_if(F.expr("m >= 0")).alias("above"), F.count("m").alias("draws"))
    mean = rows.agg(F.avg(value).alias("mean"))
    return mean.crossJoin(out).select("mean", "lo", "hi", F.least(F.lit(1.0), 2 * add_one(F.least("below", "above"), F.col("draws"))).alias("p_two_sided"), "draws")


def add_one(hits: Column, draws: Column) -> Column:
    """A Monte-Carlo p-value that is never 0."""
    return (hits + 1) / (draws + 1)


def holm(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Step-down adjustment: the running maximum of (n - rank + 1) p, at most 1. One window over the tests (there are few)."""
    n = tests.agg(F.count(F.lit(1)).alias("n"))
    r = tests.crossJoin(F.broadcast(n)).withColumn("i", F.row_number().over(Window.orderBy(p, key)))
    run = Window.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("n") - F.col("i") + 1) * F.col(p)).over(run))).drop("n", "i")


def cross_fit(events: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Each fold of groups is judged at the threshold that is best (F1, then the higher one) on the others: fold, threshold, tp, fp, fn; fold -1 is all
    folds pooled, their scores centred by their thresholds."""
    from .sweep import choose, sweep

    fold = F.pmod(F.col(group), F.lit(folds))
    parts = []
    for k in range(folds):  # a fixed small number of plans
        best = choose(sweep(events.where(fold != k)), "best_f1").select(F.col("threshold").alias("cut"))
        ok = F.coalesce(F.col("score") >= F.col("cut"), F.lit(False))
        mine = events.where(fold == k).crossJoin(F.broadcast(best))
        parts.append(mine.groupBy("cut").agg(F.count_if(ok & F.col("correct")).alias("tp"), F.count_if(ok & ~F.col("correct")).alias("fp"), F.count_if(~F.col("unknown") & ~(ok & F.col("correct"))).alias("fn")).select(F.lit(k).alias("fold"), F.col("cut").alias("threshold"), "tp", "fp", "fn"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pooled = out.agg(F.lit(-1).alias("fold"), F.lit(0.0).alias("threshold"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])  # scores less their fold's threshold, at 0
    return out.unionByName(pooled)
