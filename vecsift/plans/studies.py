"""Registered studies: grids and halves, ceilings, prior transfer, resampling, box overlap, and controls whose results are not constant."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluate as E
from ..operators import integrity as I
from ..operators import pairs as P
from ..operators import rankings as R
from ..operators import rerank as K
from ..operators import stats as B
from ..operators import sweep as T
from ..operators.graph import checkpointed
from ..sources import readers
from .retrieval import BASE, PR, SWEEP, THRESHOLD, all_rows, metric_ctes, per, presence_curve, r6, top1_events
from .tables import BOXES, boxes, folder, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# The grids of the survey.
K1S, K2S, LAMS = (4, 6, 8, 10, 12, 16, 20, 26), (1, 2, 3, 4, 6, 8), (0.0, 0.15, 0.3, 0.45, 0.6, 0.8)
K1S_FAST, K2S_FAST, LAMS_FAST = (4, 6, 8, 12, 20), (1, 2, 3, 4, 6), (0.15, 0.3, 0.45, 0.6)
DEPTHS = (10, 30, 100, 300, 750)
PRIORS = (0.1, 0.25, 0.4)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- re-ranking studies ------------------------------------------------------------------------------------------------------


@query("k8_parameter_grid")
def k8(spark, d):
    """All grid points with their mean AP, the best one marked."""
    points = checkpointed(K.grid_metrics(*P.protocol(spark, d), K1S, K2S, LAMS))
    best = K.best_point(points).select("k1", "k2", "lam", F.lit(True).alias("best"))
    return points.join(F.broadcast(best), ["k1", "k2", "lam"], "left").select("k1", "k2", "lam", r6("map_step", "map_step"), F.coalesce("best", F.lit(False)).alias("best"))


@query("b9_tune_and_announce_halves")
def b9(spark, d):
    """Identities in two halves by a hashed order: the grid's best point on one half, announced on the other, and what that costs."""
    q, g = P.protocol(spark, d)
    half = F.conv(F.substring(I.hashed_order("id"), 1, 2), 16, 10).cast("int") % 2
    out = None
    points = {h: checkpointed(K.grid_metrics(q.where(half == h), g.where(half == h), K1S_FAST, K2S_FAST, LAMS_FAST)) for h in (0, 1)}
    for tune, test in ((0, 1), (1, 0)):
        best = K.best_point(points[tune]).withColumnRenamed("map_step", "tuned")
        there = points[test].join(F.broadcast(best), ["k1", "k2", "lam"]).withColumnRenamed("map_step", "announced")
        top = points[test].agg(F.max("map_step").alias("attainable"))
        row = there.crossJoin(top).select(F.lit(tune).alias("tune"), "k1", "k2", "lam", r6("tuned", "tuned"), r6("announced", "announced"), r6("attainable", "attainable"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("k17_rerank_depth")
def k17(spark, d):
    """Mean AP when only the nearest `depth` rows are re-ranked, query by query, and the share of the joint graph's gain that is kept."""
    q, g = P.protocol(spark, d)
    base = P.labelled_pairs(q, g)
    score = lambda s: E.ranking_metrics(E.per_query(q, g, base.drop("score").join(s, ["q", "g"]))).select("map_step")
    plain = E.ranking_metrics(E.per_query(q, g, base)).select(F.col("map_step").alias("plain"))
    whole = score(K.joint_rerank(q, g, 6, 3, 0.3, g.count()).select("q", "g", "score")).select(F.col("map_step").alias("joint"))
    out = None
    for depth in DEPTHS:
        row = score(K.rerank(q, g, top=depth)).select(F.lit(depth).alias("depth"), "map_step")
        out = row if out is None else out.unionByName(row)
    kept = (F.col("map_step") - F.col("plain")) / F.nullif(F.col("joint") - F.col("plain"), F.lit(0.0))
    return out.crossJoin(plain).crossJoin(whole).select("depth", r6("map_step", "map_step"), r6("plain", "plain"), r6("joint", "joint"), r6(kept, "gain_kept"))  # one row each


# ---- ceilings and means ------------------------------------------------------------------------------------------------------


_LIFT = """SELECT q, n, inside, lifted, list_filter(range(1, 11), lambda x: NOT list_contains(inside, x)) AS free FROM (SELECT q, count(*) AS n, coalesce(list(rank ORDER BY rank) FILTER (WHERE rank <= 10), []) AS inside, count(*) FILTER (WHERE rank > 10 AND rank <= 50) AS lifted FROM h GROUP BY q)"""


@query("m20_ap_ceilings", f"""WITH {BASE}, {metric_ctes()}, k AS ({_LIFT}),
s AS (SELECT *, list_sort(list_concat(inside, free[greatest(1, len(free) - least(lifted, len(free)) + 1):])) AS low0, list_sort(list_concat(inside, free[1:least(lifted, len(free))])) AS high FROM k),
x AS (SELECT *, CASE WHEN least(lifted, len(free)) = 0 THEN list_sort(inside) ELSE low0 END AS low FROM s),
a AS (SELECT q, n, lifted, coalesce(list_sum([(i / low[i]::DOUBLE) for i in range(1, len(low) + 1)]), 0) AS lo, coalesce(list_sum([(i / high[i]::DOUBLE) for i in range(1, len(high) + 1)]), 0) AS hi, least(10, len(inside) + lifted) AS ideal FROM x)
SELECT q, lifted, round(lo / n, 6) AS lift_min_all, round(lo / least(n, 10), 6) AS lift_min_min, round(hi / n, 6) AS lift_max_all, round(hi / least(n, 10), 6) AS lift_max_min, round(ideal / n::DOUBLE, 6) AS ideal_all, round(ideal / least(n, 10)::DOUBLE, 6) AS ideal_min FROM a""")
def m20(spark, d):
    c = E.lifted_ap(P.ranked(E.eligible(P.labelled_pairs(*P.protocol(spark, d)))), 10, 50)
    return c.select("q", "lifted", *[r6(n, n) for n in ("lift_min_all", "lift_min_min", "lift_max_all", "lift_max_min", "ideal_all", "ideal_min")])


@query("a13_poisoned_mean", f"WITH {BASE}, {metric_ctes()}, x AS (SELECT q_id, n_pos, CASE WHEN n_pos / inp <= 60 THEN inp END AS inp FROM per WHERE n_pos > 0) SELECT q_id, count(*) AS n, count(inp) AS n_defined, CASE WHEN count(*) = count(inp) THEN round(avg(inp), 6) END AS poisoned, round(avg(inp), 6) AS of_defined FROM x GROUP BY q_id")
def a13(spark, d):
    """INP of lists cut at 60: it is undefined for a query whose last positive lies beyond, and so is the mean over such queries."""
    x = per(spark, d).where("n_pos > 0").withColumn("inp", F.when(F.col("n_pos") / F.col("inp") <= 60, F.col("inp")))
    return x.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count("inp").alias("n_defined"), F.round(E.poisoned_mean(F.col("inp")), 6).alias("poisoned"), r6(F.avg("inp"), "of_defined"))


# ---- thresholds --------------------------------------------------------------------------------------------------------------

for _tie, _order in (("lowest", "ASC"), ("highest", "DESC")):

    @query(f"t8_best_f1_{_tie}", PR + f", f AS (SELECT round(threshold, 1) AS threshold, max(tp) AS tp, max(fp) AS fp FROM pr GROUP BY 1), y AS (SELECT threshold, tp / (tp + fp)::DOUBLE AS p, tp / (SELECT count(*) FROM ev WHERE correct)::DOUBLE AS r FROM f) SELECT threshold, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM y ORDER BY round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) DESC, threshold {_order} LIMIT 1")
    def t8(spark, d, tie=_tie):
        """Over scores of one decimal, so that the curve is coarse."""
        c = presence_curve(spark, d).groupBy(F.round("threshold", 1).alias("threshold")).agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"), F.max("recall").alias("recall"))
        c = c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
        return T.best_f1(c, tie).select("threshold", r6("f1", "f1"))


@query("t7_prior_transfer", SWEEP + f""", pw AS (SELECT unnest({list(PRIORS)!r}::DOUBLE[]) AS prior),
fa AS (SELECT threshold, prior, 2 * tp / nullif(2 * tp + (fp - fp_unknown) + prior / (1 - prior) * (SELECT known FROM n) / (SELECT nu FROM n) * fp_unknown + fn, 0)::DOUBLE AS f1 FROM sw, pw WHERE threshold IS NOT NULL),
best AS (SELECT prior, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY prior ORDER BY round(f1, 9) DESC, threshold DESC) AS place FROM fa) WHERE place = 1)
SELECT c.prior AS chosen_at, fa.prior AS used_at, round(fa.threshold, 6) AS threshold, round(fa.f1, 6) AS f1, round(b.f1 - fa.f1, 6) AS regret FROM best c JOIN fa ON fa.threshold = c.threshold JOIN best b ON b.prior = fa.prior""")
def t7(spark, d):
    return T.prior_transfer(top1_events(spark, d), PRIORS).select("chosen_at", "used_at", r6("threshold", "threshold"), r6("f1", "f1"), r6("regret", "regret"))


# ---- resampling --------------------------------------------------------------------------------------------------------------


def bootstrap_sql(rows: str, value: str, unit: str, draws: int) -> str:
    times = B.poisson1_sql("u")
    return f"""WITH {BASE}, {metric_ctes()}, x AS ({rows}), un AS (SELECT {unit} AS unit, sum({value}) AS s, count({value}) AS n FROM x GROUP BY 1),
dr AS (SELECT s, n, draw, {B.uniform_sql("1", "draw", "unit")} AS u FROM un, range(1, {draws + 1}) t(draw)),
ea AS (SELECT draw, sum(({times}) * s) / nullif(sum(({times}) * n), 0)::DOUBLE AS m FROM dr GROUP BY draw),
ag AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, count(*) FILTER (WHERE m <= 0) AS below, count(*) FILTER (WHERE m >= 0) AS above, count(m) AS draws FROM ea)
SELECT round((SELECT avg({value}) FROM x), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(least(1, 2 * (least(below, above) + 1) / (draws + 1)::DOUBLE), 6) AS p_two_sided, draws FROM ag"""


def rounded(b):
    return b.select(r6("mean", "mean"), r6("lo", "lo"), r6("hi", "hi"), r6("p_two_sided", "p_two_sided"), "draws")


@query("b1_paired_bootstrap", bootstrap_sql("SELECT q, ap - ap_trapezoid AS diff FROM per WHERE ap IS NOT NULL", "diff", "q", 4000))
def b1(spark, d):
    x = per(spark, d).where("ap IS NOT NULL").select("q", (F.col("ap") - F.col("ap_trapezoid")).alias("diff"))
    return rounded(B.bootstrap_mean(x, "diff", "q"))


@query("b2_cluster_bootstrap", bootstrap_sql("SELECT q_id, ap FROM per WHERE ap IS NOT NULL", "ap", "q_id", 4000))
def b2(spark, d):
    return rounded(B.bootstrap_mean(per(spark, d).where("ap IS NOT NULL"), "ap", "q", cluster="q_id"))


@query("b7_mean_interval", "SELECT b.*, n_plus, n_minus, p_sign FROM (" + bootstrap_sql("SELECT q, inp FROM per WHERE inp IS NOT NULL", "inp", "q", 10000) + f") b, (WITH {BASE}, {metric_ctes()}, " + """c AS (SELECT count(*) FILTER (WHERE ap > ap_trapezoid) AS n_plus, count(*) FILTER (WHERE ap < ap_trapezoid) AS n_minus FROM per)
SELECT n_plus, n_minus, round(least(1, 2 * (SELECT sum(exp(lgamma(n_plus + n_minus + 1) - lgamma(k + 1) - lgamma(n_plus + n_minus - k + 1) - (n_plus + n_minus) * ln(2))) FROM range(0, least(n_plus, n_minus) + 1) t(k))), 6) AS p_sign FROM c)""")
def b7(spark, d):
    """The interval of a mean, and the sign test of the two precision rules' difference."""
    p = per(spark, d)
    signs = B.sign_test(p.where("ap IS NOT NULL").select((F.col("ap") - F.col("ap_trapezoid")).alias("diff")), "diff")
    return rounded(B.bootstrap_mean(p.where("inp IS NOT NULL"), "inp", "q", draws=10_000)).crossJoin(signs.select("n_plus", "n_minus", r6("p_sign", "p_sign")))  # one row each


@query("b4_stratified_bootstrap_of_sweep", SWEEP + f""", dr AS (SELECT *, {B.uniform_sql("7", "unknown", "draw", "q_id")} AS u FROM ev, range(1, 501) t(draw)),
w AS (SELECT *, {B.poisson1_sql("u")} AS k FROM dr WHERE score IS NOT NULL),
c AS (SELECT draw, score, sum(CASE WHEN correct THEN k ELSE 0 END) OVER up AS t, sum(k) OVER up AS a, sum(CASE WHEN unknown THEN 0 ELSE k END) OVER (PARTITION BY draw) AS known FROM w WHERE k > 0 WINDOW up AS (PARTITION BY draw ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
b AS (SELECT draw, score FROM (SELECT draw, score, row_number() OVER (PARTITION BY draw ORDER BY 2 * t / (a + known)::DOUBLE DESC, score DESC) AS place FROM c) WHERE place = 1)
SELECT round(quantile_cont(score, 0.025), 6) AS lo, round(quantile_cont(score, 0.975), 6) AS hi, count(*) AS draws FROM b""")
def b4(spark, d):
    """The threshold of the best F1 over resampled identities, known and unknown drawn apart: multiplicities weigh the sweep."""
    p = per(spark, d)
    ev = E.refusal_events(p, None, "top1").join(p.select("q", "q_id"), "q")
    k = B.multiplicities(ev, ["unknown", "q_id"], 500, 7)
    w = ev.where("score IS NOT NULL").select("q_id", "score", "correct", "unknown").join(k, ["unknown", "q_id"])
    run = Window.partitionBy("draw").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    c = w.withColumn("t", F.sum(F.when(F.col("correct"), F.col("k")).otherwise(0)).over(run)).withColumn("a", F.sum("k").over(run)).withColumn("known", F.sum(F.when(F.col("unknown"), 0).otherwise(F.col("k"))).over(Window.partitionBy("draw")))
    best = c.withColumn("f1", 2 * F.col("t") / (F.col("a") + F.col("known"))).groupBy("draw").agg(F.max(F.struct("f1", "score")).alias("b"))
    return best.agg(r6(F.expr("percentile(b.score, 0.025)"), "lo"), r6(F.expr("percentile(b.score, 0.975)"), "hi"), F.count(F.lit(1)).alias("draws"))


@query("b5_cross_fit", SWEEP + """, fo AS (SELECT unnest(range(5)) AS fold),
tr AS (SELECT fold, ev.* FROM ev, fo WHERE q_id % 5 <> fold),
kn AS (SELECT fold, count(*) FILTER (WHERE NOT unknown) AS known FROM tr GROUP BY fold),
g5 AS (SELECT fold, score, count(*) FILTER (WHERE correct) AS t, count(*) AS a FROM tr WHERE score IS NOT NULL GROUP BY fold, score),
c5 AS (SELECT fold, score, sum(t) OVER up AS t, sum(a) OVER up AS a FROM g5 WINDOW up AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
b5 AS (SELECT fold, score AS threshold FROM (SELECT fold, score, row_number() OVER (PARTITION BY fold ORDER BY 2 * t / (a + known)::DOUBLE DESC, score DESC) AS place FROM c5 JOIN kn USING (fold)) WHERE place = 1),
r5 AS (SELECT fold, threshold, count(*) FILTER (WHERE score >= threshold AND correct) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT correct) AS fp, count(*) FILTER (WHERE NOT unknown AND NOT (coalesce(score >= threshold, FALSE) AND correct)) AS fn FROM ev JOIN b5 ON q_id % 5 = fold GROUP BY fold, threshold)
SELECT fold::INT AS fold, round(threshold, 6) AS threshold, tp, fp, fn FROM r5 UNION ALL SELECT -1, 0.0, coalesce(sum(tp), 0)::BIGINT, coalesce(sum(fp), 0)::BIGINT, coalesce(sum(fn), 0)::BIGINT FROM r5""")
def b5(spark, d):
    p = per(spark, d)
    ev = E.refusal_events(p, None, "top1").join(p.select("q", "q_id"), "q")
    return B.cross_fit(ev, "q_id").select("fold", r6("threshold", "threshold"), "tp", "fp", "fn")


@query("b8_random_control", f"""WITH {BASE}, se AS (SELECT unnest([1, 2, 3]) AS seed),
rv AS (SELECT vec_id, seed, list(({B.uniform_sql("seed", "vec_id", "i")}) - 0.5 ORDER BY i) AS v FROM e, se, range(0, 64) t(i) GROUP BY vec_id, seed),
sc AS (SELECT a.seed, p.q, p.g, p.q_id, p.g_id, p.q_cam, p.g_cam, list_cosine_similarity(a.v, b.v) AS score FROM p JOIN rv a ON a.vec_id = p.q JOIN rv b ON b.vec_id = p.g AND a.seed = b.seed WHERE {"NOT (q_id = g_id AND q_cam = g_cam)"}),
ra AS (SELECT *, row_number() OVER (PARTITION BY seed, q ORDER BY score DESC, g) AS rank FROM sc),
hi AS (SELECT *, row_number() OVER (PARTITION BY seed, q ORDER BY rank) AS hit FROM ra WHERE q_id = g_id),
ap AS (SELECT seed, q, avg(hit / rank::DOUBLE) AS ap FROM hi GROUP BY seed, q)
SELECT seed, round(avg(ap), 6) AS map_step FROM ap GROUP BY seed""")
def b8(spark, d):
    """Random vectors in place of the real ones: three seeds, in one plan each over small tables of draws."""
    q, g = P.protocol(spark, d)
    out = None
    for seed in (1, 2, 3):
        fake = lambda df, s=seed: df.withColumn("v", F.transform("v", lambda x, i: B.uniform(F.lit(s), F.col("key"), i) - 0.5))
        m = E.ranking_metrics(R.per_query(fake(q), fake(g))).select(F.lit(seed).alias("seed"), r6("map_step", "map_step"))
        out = m if out is None else out.unionByName(m)
    return out


# ---- boxes -------------------------------------------------------------------------------------------------------------------

_IOU = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query("v22_iou_pairs", f"WITH b AS (SELECT * FROM ({BOXES})), p AS (SELECT a.key AS a, b.key AS b, {_IOU} AS i, a.w * a.h + b.w * b.h AS u FROM b a JOIN b ON b.x BETWEEN a.x - 9 AND a.x + 9 AND b.y BETWEEN a.y - 7 AND a.y + 7 AND a.key < b.key) SELECT a, b, round(i / (u - i)::DOUBLE, 6) AS iou FROM p WHERE i / (u - i)::DOUBLE >= 0.9")
def v22(spark, d):
    s = boxes(spark, d)
    return P.iou_join(s, s, 0.9, 44, 34).where("a < b").select("a", "b", r6("iou", "iou"))


_FRAMED = "SELECT *, (vec_id * 7 % 60)::BIGINT AS x, (vec_id * 11 % 45)::BIGINT AS y, (20 + vec_id % 9)::BIGINT AS w, (15 + vec_id % 7)::BIGINT AS h FROM"


@query("j3_cross_set_join", f"WITH {BASE}, qb AS ({_FRAMED} qq), gb AS ({_FRAMED} gg), o AS (SELECT a.vec_id AS q, b.vec_id AS g, {_IOU} AS i, a.w * a.h + b.w * b.h AS u, list_cosine_similarity(a.v, b.v) AS score FROM qb a, gb b) SELECT 'near' AS rule, q, g, round(score, 6) AS sim FROM p WHERE score >= 0.35 UNION ALL SELECT 'overlap', q, g, round(score, 6) FROM o WHERE i / (u - i)::DOUBLE >= 0.8 AND score < 0.35")
def j3(spark, d):
    """Pairs across the sets that are near, and those whose boxes nearly coincide though they are not near."""
    q, g = P.protocol(spark, d)
    box = lambda df: df.select("key", (F.col("key") * 7 % 60).alias("x"), (F.col("key") * 11 % 45).alias("y"), (F.col("key") % 9 + 20).alias("w"), (F.col("key") % 7 + 15).alias("h"))
    near = P.score_pairs(q, g, least=0.35).select(F.lit("near").alias("rule"), "q", "g", r6("score", "sim"))
    over = P.iou_join(box(q), box(g), 0.8, 28, 21).join(q.select(F.col("key").alias("a"), F.col("v").alias("qv")), "a").join(g.select(F.col("key").alias("b"), F.col("v").alias("gv")), "b")
    over = over.withColumn("score", V.cosine(F.col("qv"), F.col("gv"))).where("score < 0.35")
    return near.unionByName(over.select(F.lit("overlap").alias("rule"), F.col("a").alias("q"), F.col("b").alias("g"), r6("score", "sim")))


# ---- controls ----------------------------------------------------------------------------------------------------------------


@query("o5_exact_partition", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 3 <> 1 AND c_custkey % 7 <> 0) AS in_none, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 7 = 0) AS in_both FROM customer")
def o5(spark, d):
    """Two parts are a partition when nothing is in none and nothing in both; these two are not."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    part = lambda cond, name: c.where(cond).select("k", F.lit(1).alias(name))
    x = c.join(part("k % 3 = 0", "a"), "k", "left").join(part("k % 3 = 1 OR k % 7 = 0", "b"), "k", "left")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a IS NULL AND b IS NULL")).alias("in_none"), F.count_if(F.expr("a IS NOT NULL AND b IS NOT NULL")).alias("in_both"))


@query("s4_id_list_order", "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey::VARCHAR) AS a, row_number() OVER (ORDER BY s_suppkey) AS b FROM supplier) SELECT count(*) FILTER (WHERE a <> b) AS n_misplaced, count(*) AS n FROM s")
def s4(spark, d):
    """A list of ids written in the order of its strings, against the order of the numbers."""
    path = folder(spark)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    s.coalesce(1).orderBy("id").write.text(path)
    ids = readers.read_ids(spark, path)
    place = lambda df, *o: df.select("id", F.row_number().over(Window.orderBy(*o)).alias("place"))  # noqa: E731  a list of ids
    bad = readers.same_order(place(ids, "line", "pos"), place(s, F.col("id").cast("long")), "id", "place").agg(F.count(F.lit(1)).alias("n_misplaced"))
    return bad.crossJoin(ids.agg(F.count(F.lit(1)).alias("n")))


@query("s9_s10_gallery_store", "SELECT count(*) AS n, count(*) AS again, count(*) FILTER (WHERE vec_id < 100) AS differing FROM embeddings WHERE vec_id % 5 <> 0 AND label < 8")
def s9(spark, d):
    """A store that is filled and partly overwritten: as many rows as before, and those overwritten differ from the source."""
    from ..sources.store import Gallery

    g = P.protocol(spark, d)[1]
    store = Gallery(spark, folder(spark))
    n = store.recreate(g)
    store.upsert(g.where("key < 100").withColumn("v", F.transform("v", lambda x: x + 0.25)))
    return spark.createDataFrame([(n, store.count(), store.seed(g).count())], "n long, again long, differing long")


@query("i7_runtime_agreement", f"WITH {BASE}, r AS (SELECT q, g, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS rank FROM p) SELECT count(*) AS n, count(*) AS agreeing, round(sum(score), 4) AS total FROM r WHERE rank <= 3")
def i7(spark, d):
    """The block products and the column expression, two ways to the same scores: the three nearest of each query agree."""
    q, g = P.protocol(spark, d)
    near = P.top_k(q, g, 3)
    both = near.join(q.select(F.col("key").alias("q"), F.col("v").alias("qv")), "q").join(g.select(F.col("key").alias("g"), F.col("v").alias("gv")), "g")
    other = V.cosine(F.col("qv"), F.col("gv"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(other - F.col("score")) < 1e-9).alias("agreeing"), F.round(F.sum(other), 4).alias("total"))


# ---- splits by hashed orders -------------------------------------------------------------------------------------------------

_ROWS = "SELECT vec_id AS key, label AS id, (vec_id // 5) % 4 AS cam FROM embeddings"


@query("p2_quota_split", f"""WITH e AS ({_ROWS}), s AS (SELECT id, count(*) AS n FROM e GROUP BY id),
c AS (SELECT id, sum(n) OVER (ORDER BY md5('0|' || id) ROWS UNBOUNDED PRECEDING) / (SELECT count(*) FROM e)::DOUBLE AS run FROM s),
r AS (SELECT id, CASE WHEN run <= 0.3 + 1e-9 THEN 'query' WHEN run <= 0.6 + 1e-9 THEN 'gallery' WHEN run <= 1.0 + 1e-9 THEN 'fit' ELSE 'unused' END AS role FROM c),
x AS (SELECT e.*, role, row_number() OVER (PARTITION BY e.id, cam ORDER BY md5('0|' || key)) AS k FROM e JOIN r USING (id))
SELECT key, CASE WHEN role = 'gallery' AND k > 1 THEN 'unused' ELSE role END AS role FROM x""")
def p2(spark, d):
    r = I.quota_split(all_rows(spark, d).select("key", "id", "cam"), "key", "id", "cam", {"query": 0.3, "gallery": 0.3, "fit": 0.4})
    return r.select("key", "role")


@query("p7_batch_sampler", f"""WITH e AS ({_ROWS}), t AS (SELECT *, row_number() OVER (PARTITION BY id, cam ORDER BY md5('0|' || key)) AS turn FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, md5('0|' || cam)) AS k FROM t),
g AS (SELECT id, (row_number() OVER (ORDER BY md5('0|' || id)) - 1) // 4 AS batch FROM (SELECT DISTINCT id FROM n))
SELECT batch, key, id, cam FROM n JOIN g USING (id) WHERE k <= 4""")
def p7(spark, d):
    return I.batch_plan(all_rows(spark, d), "key", "id", "cam", 4, 4)


@query("s15_run_manifest", f"WITH {BASE} SELECT (SELECT count(*) FROM qq) AS queries, (SELECT count(*) FROM gg) AS gallery, count(*) AS candidates, count(DISTINCT q) AS answered, 10 AS k, {THRESHOLD}::DOUBLE AS threshold FROM p WHERE score >= {THRESHOLD}")
def s15(spark, d):
    """The run's manifest, read back from its JSON."""
    from ..sources import sinks

    q, g = P.protocol(spark, d)
    m = sinks.manifest(q, g, P.score_pairs(q, g, least=THRESHOLD), {"k": 10, "threshold": THRESHOLD})
    j = F.from_json("run_info", "queries long, gallery long, candidates long, answered long, params string")
    p = F.from_json("j.params", "k int, threshold double")
    return m.select(j.alias("j")).select("j.queries", "j.gallery", "j.candidates", "j.answered", p["k"].alias("k"), p["threshold"].alias("threshold"))
