"""Hand-computed cases of the metrics, and the behaviour of search, re-ranking, graphs and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsift.functions import vectors as V
from vecsift.operators import evaluate as E
from vecsift.operators import graph, integrity, pairs, rerank, stats, sweep


def ranking(spark, *lists):
    """One query per string of P, N and J (excluded), best first."""
    rows = []
    for q, s in enumerate(lists):
        for k, c in enumerate(s):
            rows.append((q, k, 1.0 - k / 100, 1, 1 if c in "PJ" else 2, 0, 0 if c == "J" else 1, 0, 9))
    return spark.createDataFrame(rows, "q long, g long, score double, q_id int, g_id int, q_cam int, g_cam int, q_frame int, g_frame int")


CASES = {"P": (1, 1, 1, 1), "NP": (1 / 2, 1 / 4, 0, 1 / 2), "NPNPP": (8 / 15, 73 / 180, 0, 3 / 5), "PNNNNP": (2 / 3, 19 / 30, 1, 1 / 3), "NNNNNP": (1 / 6, 1 / 12, 0, 1 / 6), "JNP": (1 / 2, 1 / 4, 0, 1 / 2)}


def test_average_precision_cases(spark):
    p = ranking(spark, *CASES)
    h = E.hits(pairs.ranked(E.eligible(p)))
    got = {r["q"]: r for r in h.groupBy("q").agg(F.avg(E.step_precision()).alias("ap"), F.avg(E.trapezoid_precision()).alias("tz"), F.min("rank").alias("first"), (F.count(F.lit(1)) / F.max("rank")).alias("inp")).collect()}
    for q, (ap, tz, rank1, inp) in enumerate(CASES.values()):
        r = got[q]
        assert (r["ap"], r["tz"], r["inp"]) == pytest.approx((ap, tz, inp))
        assert int(r["first"] == 1) == rank1


def test_undefined_is_null(spark):
    p = ranking(spark, "NNN")
    q = spark.createDataFrame([(0, 1, 0)], "key long, id int, cam int")
    g = spark.createDataFrame([(0, 2)], "key long, id int")
    m = E.ranking_metrics(E.per_query(q, g, p)).first()
    assert m["n_valid"] == 0 and m["map_step"] is None and m["rank1"] is None


def events(spark, rows):
    return spark.createDataFrame([(i, s, c, not c) for i, (s, c) in enumerate(rows)], "q long, score double, correct boolean, unknown boolean")


def test_presence_refusal_and_curve(spark):
    ev = events(spark, [(0.9, True), (0.85, False), (0.8, True), (0.2, True), (0.1, False)])
    c = E.confusion(ev, F.count_if(~F.col("unknown")), 0.5).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 1, 1)
    assert (c["precision"], c["recall"], c["f1"], c["tnr"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 1 / 2))
    a = E.curve_areas(E.pr_curve(ev, 3)).first()
    assert (a["ap_step"], a["auc_trapezoid"]) == pytest.approx((29 / 36, 55 / 72))


def test_ties_are_one_point(spark):
    c = E.pr_curve(events(spark, [(1.0, True), (1.0, False)]), 1)
    assert c.count() == 1
    a = E.curve_areas(c).first()
    assert (a["ap_step"], a["auc_trapezoid"]) == pytest.approx((1 / 2, 3 / 4))


def test_sweep_agrees_with_direct_evaluation(spark):
    ev = events(spark, [(0.9, True), (0.9, False), (0.4, True), (0.3, False)])
    for r in sweep.sweep(ev).where("threshold IS NOT NULL").collect():
        c = E.confusion(ev, F.count_if(~F.col("unknown")), r["threshold"]).first()
        assert (r["tp"], r["f1"], r["tnr"]) == pytest.approx((c["tp"], c["f1"], c["tnr"]))
    assert sweep.sweep(ev).where("threshold IS NULL").first()["tp"] == 0


def vectors(spark, m, ids=None):
    return spark.createDataFrame([(k, int(ids[k]) if ids is not None else k, k % 2, k, [float(x) for x in v]) for k, v in enumerate(m)], "key long, id int, cam int, frame long, v array<double>")


def test_one_hot_is_perfect_and_independent_of_the_batch(spark):
    rows = vectors(spark, np.eye(6))
    s = pairs.search(rows, rows, 3, 0.5).orderBy("q").collect()
    assert [r["accepted"] for r in s] == [str(k) for k in range(6)] and not any(r["refusal"] for r in s)
    alone = pairs.search(rows.where("key = 3"), rows, 3, 0.5).first()
    assert alone == s[3]


def test_equality_with_the_threshold_and_empty_gallery(spark):
    rows = vectors(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert pairs.search(rows, rows, 2, 1.0).where("refusal").count() == 0
    r = pairs.search(rows, rows.limit(0), 2, -1.0).first()
    assert r["refusal"] and r["best_confidence"] is None


def test_zero_vector_is_an_error(spark):
    with pytest.raises(Exception, match="zero vector"):
        vectors(spark, [[0.0, 0.0]]).select(V.unit(F.col("v"))).collect()


def test_rerank_does_not_depend_on_other_queries_and_keeps_the_rest_below(spark):
    rng = np.random.default_rng(0)
    g, q = vectors(spark, rng.normal(size=(60, 5))), vectors(spark, rng.normal(size=(2, 5)))
    both = {(r["q"], r["g"]): r["score"] for r in rerank.rerank(q, g, top=10).collect()}
    one = {(r["q"], r["g"]): r["score"] for r in rerank.rerank(q.where("key = 1"), g, top=10).collect()}
    assert len(both) == 120 and all(both[k] == pytest.approx(v) for k, v in one.items())
    best = {r["g"] for r in pairs.top_k(q, g, 10).where("q = 1").collect()}
    order = sorted(one, key=lambda k: -one[k])
    assert {k[1] for k in order[:10]} == best


def test_joint_rerank_against_the_whole_matrix_and_over_many_rows(spark):
    m = np.random.default_rng(5).normal(size=(240, 6))
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    d = 1 - np.clip(u @ u.T, -1, 1)
    np.fill_diagonal(d, 0.0)
    rows = vectors(spark, m).withColumn("key", F.col("key").cast("long"))
    for k1, k2 in ((6, 3), (5, 1)):
        got = {}
        for r in rerank.joint_rerank(rows.where("key % 5 = 0"), rows.where("key % 5 <> 0"), k1, k2, 0.3, 10).collect():
            got.setdefault(r["q"], []).append((r["rank"], r["g"], r["score"]))
        assert sorted(got) == list(range(0, 240, 5))
        for q, found in got.items():
            o = np.r_[q, np.delete(np.arange(240), q)]
            want = sorted((-(1 - x), g) for g, x in zip(o[1:], rerank.local_distances(d[np.ix_(o, o)], k1, k2, 0.3)[1:]) if g % 5)[:10]
            assert [g for _, g, _ in sorted(found)] == [g for _, g in want]
            assert [s for _, _, s in sorted(found)] == pytest.approx([-s for s, _ in want])
    many = np.random.default_rng(6).normal(size=(5200, 4))
    many[::13] = many[0]  # 400 copies
    rows = vectors(spark, many).withColumn("key", F.col("key").cast("long"))
    n = rerank.joint_rerank(rows.where("key % 50 = 0"), rows.where("key % 50 <> 0"), 6, 3, 0.3, 10).groupBy("q").agg(F.count("score").alias("n"), F.max("score").alias("most")).collect()
    assert len(n) == 104 and {r["n"] for r in n} == {10} and all(0 <= r["most"] <= 1 for r in n)


def test_diffusion_against_the_whole_matrix_and_beyond_reach(spark):
    r = np.random.default_rng(8)
    m = r.normal(size=(200, 5))
    m[150:] = [1, 0, 0, 0, 0] + r.normal(size=(50, 5)) * 1e-3  # a tight group
    m[[0, 5]] = [-9, -9, -9, -9, -9], m[160]
    queries = np.arange(200) % 5 == 0
    gk = np.flatnonzero(~queries)
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    cos = np.clip(u[~queries] @ u[~queries].T, 0, 1)
    np.fill_diagonal(cos, 0)
    rows = vectors(spark, m)
    for k, alpha in ((10, 0.9), (3, 0.8)):
        near = np.zeros_like(cos, bool)
        np.put_along_axis(near, np.argsort(-cos, 1, kind="stable")[:, :k], True, 1)
        a = np.where(near & near.T, cos**3, 0)
        d = a.sum(1)
        d = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
        s = d[:, None] * a * d
        c = np.clip(u[queries] @ u[~queries].T, -1, 1)
        y = np.zeros_like(c)
        first = np.argsort(-c, 1, kind="stable")[:, :3]
        np.put_along_axis(y, first, np.clip(np.take_along_axis(c, first, 1), 0, 1) ** 3, 1)
        f = y
        for _ in range(25):
            f = alpha * f @ s + (1 - alpha) * y
        got = {}
        for x in graph.diffusion(rows.where("key % 5 = 0"), rows.where("key % 5 <> 0"), k, alpha=alpha).collect():
            got.setdefault(x["q"], []).append((x["rank"], x["g"], x["score"]))
        for i, q in enumerate(np.flatnonzero(queries)):
            want = np.lexsort((-c[i], -f[i]))[:10]
            assert [x[1] for x in sorted(got[q])] == gk[want].tolist()
            assert [x[2] for x in sorted(got[q])] == pytest.approx(f[i, want].tolist())
    assert min(f[:, :].astype(bool).sum(1)) < 10  # some walks end before ten rows


def test_components_of_a_path_a_cycle_and_lone_nodes(spark):
    nodes = spark.range(30).withColumnRenamed("id", "key")
    edges = spark.createDataFrame([(k, k + 1) for k in range(14)] + [(20, 21), (21, 22), (22, 20), (5, 5)], "a long, b long")
    got = {r["key"]: r["component"] for r in graph.components(spark, nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(15)) and got[22] == 20 and got[29] == 29


def test_band_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    make = lambda: spark.createDataFrame([(k, *map(int, rng.integers(-20, 60, 2))) for k in range(80)], "key long, x int, y int")
    a, b = make().cache(), make().cache()
    got = {tuple(r) for r in pairs.band_join(a, b, ["x", "y"], 5).collect()}
    assert got == {(p["key"], q["key"]) for p in a.collect() for q in b.collect() if abs(p["x"] - q["x"]) <= 5 and abs(p["y"] - q["y"]) <= 5}


def test_bootstrap_holds_the_mean_and_is_reproducible(spark):
    x = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("v"))
    a, b = (stats.bootstrap_mean(x.repartition(n), "v", "id", 300).first() for n in (2, 7))
    assert a == b and a["lo"] < 4.5 < a["hi"] and 0 < a["p_two_sided"] < 0.05


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    got = {r["name"]: r["p_holm"] for r in stats.holm(t).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_split_corruptions_break_their_own_rules(spark):
    rows = spark.createDataFrame([(0, 1, 0, "x"), (1, 1, 1, "y"), (2, 2, 0, "z"), (3, 3, 0, "w")], "key long, id int, cam int, body string")
    good = [(0, "query", True), (1, "gallery", None), (2, "fit", None), (3, "query", False)]
    count = lambda a, r=rows: {x["rule"]: x["n"] for x in integrity.split_violations(r, spark.createDataFrame(a, "key long, role string, known boolean"), content="body").collect()}
    assert set(count(good).values()) == {0}
    assert count(good[:3])["S0"] == 1
    assert count([(0, "query", True), (1, "fit", None), *good[2:]])["P1"] == 1
    assert count(good, rows.withColumn("cam", F.lit(0)))["P2"] == 1
    assert count([*good[:3], (3, "query", True)])["P3"] == 1
    assert count(good, rows.withColumn("body", F.when(F.col("key") == 2, "x").otherwise(F.col("body"))))["P4"] == 1


def test_npy_source_and_publication(spark, tmp_path):
    from vecsift.sources import readers, sinks

    np.save(tmp_path / "m.npy", np.arange(12.0).reshape(6, 2))
    spark.dataSource.register(readers.NpyDataSource)
    got = spark.read.format("npy").option("path", str(tmp_path / "m.npy")).option("rows", 4).load().orderBy("row_no").collect()
    assert [r["v"] for r in got] == [[2.0 * k, 2.0 * k + 1] for k in range(6)]
    out = str(tmp_path / "out")
    sinks.publish(spark, {"a": (spark.range(3), {"header": True})}, out)
    assert spark.read.csv(f"{out}/a", header=True).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"a": (spark.range(3), {})}, out)


def test_stream_equals_batch_for_any_trigger(spark):
    from vecsift.streaming.retrieval import retrieve_stream

    rng = np.random.default_rng(2)
    q, g = vectors(spark, rng.normal(size=(9, 4))), vectors(spark, rng.normal(size=(20, 4)))
    want = sorted(map(tuple, pairs.top_k(q, g, 3).select("q", "g", "rank").collect()))
    for per in (1, 4):
        assert sorted(map(tuple, retrieve_stream(spark, q, g, 3, per_trigger=per).collect())) == want
