"""Studies against the plain operators they are made of, with blocks on both sides."""

import math

import pytest
from conftest import SF

from vecsift.operators import evaluate, pairs, rerank, stats, sweep


def test_grid_points_are_the_reranked_metrics(spark):
    q, g = pairs.protocol(spark, SF)
    got = {(r["k1"], r["k2"], r["lam"]): r["map_step"] for r in rerank.grid_metrics(q, g, (4, 6), (1, 3, 5), (0.0, 0.3), top=20).collect()}
    assert set(got) == {(a, b, c) for a in (4, 6) for b in (1, 3, 5) if b <= a for c in (0.0, 0.3)}
    base = pairs.labelled_pairs(q, g).drop("score")
    for k1, k2, lam in ((4, 1, 0.3), (6, 3, 0.3), (6, 5, 0.0)):
        scores = rerank.rerank(q, g, k1, k2, lam, top=20)
        direct = evaluate.ranking_metrics(evaluate.per_query(q, g, base.join(scores, ["q", "g"]))).first()["map_step"]
        assert got[k1, k2, lam] == pytest.approx(direct)


def test_blocks_of_queries_and_thresholds_change_nothing(spark, monkeypatch):
    q, g = pairs.protocol(spark, SF)
    whole = {(r["q"], r["g"]): r["score"] for r in pairs.score_pairs(q, g).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 17)
    monkeypatch.setattr(pairs, "ASKED", 7)
    cut = {(r["q"], r["g"]): r["score"] for r in pairs.score_pairs(q, g).collect()}
    assert cut.keys() == whole.keys() and all(cut[k] == pytest.approx(whole[k]) for k in whole)
    least = {(r["q"], r["g"]) for r in pairs.score_pairs(q, g, least=0.2).collect()}
    assert least == {k for k, v in whole.items() if v >= 0.2}


def test_lifted_ap(spark):
    rows = [(1, g, r, 1, 1 if r in (2, 4, 12, 14, 60) else 2) for g, r in enumerate(range(1, 61))]
    ranking = spark.createDataFrame(rows, "q long, g long, rank int, q_id int, g_id int")
    r = evaluate.lifted_ap(ranking, 10, 50).first()
    low, high = [2, 4, 9, 10], [1, 2, 3, 4]
    ap = lambda places: sum((k + 1) / p for k, p in enumerate(places))
    assert (r["n"], r["lifted"]) == (5, 2)
    assert r["lift_min_all"] == pytest.approx(ap(low) / 5) and r["lift_max_min"] == pytest.approx(ap(high) / 5) and r["ideal_all"] == pytest.approx(4 / 5)


def test_poisoned_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 1.0), (2, None)], "k int, x double")
    assert dict(map(tuple, df.groupBy("k").agg(evaluate.poisoned_mean(df["x"])).collect())) == {1: 2.0, 2: None}


def test_ties_of_the_best_f1(spark):
    c = spark.createDataFrame([(0.9, 0.5, 0.5), (0.5, 0.5, 0.5), (0.7, 0.1, 0.1), (None, 1.0, 1.0)], "threshold double, precision double, recall double")
    assert sweep.best_f1(c, "lowest").first()["threshold"] == 0.5 and sweep.best_f1(c, "highest").first()["threshold"] == 0.9


def test_running_sums_by_ranges(spark):
    rows = [(k / 37 - 1.3, k % 5, 1) for k in range(100)]
    got = {r["s"]: (r["a"], r["b"]) for r in sweep.running(spark.createDataFrame(rows, "s double, a long, b long"), "s", ["a", "b"], grain=3).collect()}
    assert got == {s: (sum(a for t, a, _ in rows if t >= s), sum(1 for t, _, _ in rows if t >= s)) for s, _, _ in rows}


def test_sign_test(spark):
    for plus, minus in ((8, 2), (0, 5), (3, 3), (0, 0)):
        df = spark.createDataFrame([(1.0,)] * plus + [(-1.0,)] * minus + [(0.0,)] * 3, "x double")
        n, m = plus + minus, min(plus, minus)
        want = min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n) if n else None
        assert stats.sign_test(df, "x").first()["p_sign"] == (pytest.approx(want) if n else None)


def test_boxes_with_other_corners(spark):
    boxes = [(k, (k * 7) % 23, (k * 5) % 19, 5 + k % 17, 4 + k % 13) for k in range(250)] + [(900, 0, 0, 0, 5)]
    df = spark.createDataFrame(boxes, "key long, x long, y long, w long, h long")

    def iou(a, b):
        i = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        return i / (a[3] * a[4] + b[3] * b[4] - i)

    for least in (0.3, 0.8):
        got = sorted((r["a"], r["b"]) for r in pairs.iou_join(df, df, least, 21, 16).collect())
        assert got == sorted((a[0], b[0]) for a in boxes for b in boxes if a[3] and b[3] and iou(a, b) >= least)
