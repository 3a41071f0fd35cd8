"""Queries whose results need every ranking, but no table of pairs: they must give the SQL's rows without one."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_oracles import plain

from vecsift import registry
from vecsift.operators import evaluate, pairs, rankings, rerank, stats

WITHOUT_PAIRS = [
    "m1_m5_per_query",
    "p9_relation_loss",
    "f7_exclusions",
    "k15_twins",
    "m16_m17_incomplete_lists",
    "k1_kreciprocal_top50",
    "b8_perfect_control",
    "m1_m4_ranking_market",
    "a13_poisoned_mean",
    "b3_add_one_p",
    "m18_map_all_queries",
    "m12_pr_curve",
    "m12_curve_areas",
    "t3_prior_weighted_sweep",
    "t5_target_tnr_threshold",
    "t7_prior_transfer",
    "t8_best_f1_lowest",
    "b1_paired_bootstrap",
    "b8_random_control",
    "m1_m4_ranking_all_same_camera",
    "m1_m4_ranking_none",
    "b4_stratified_bootstrap_of_sweep",
    "b7_mean_interval",
]


@pytest.fixture
def no_pairs(monkeypatch):
    def made(*a, **b):
        raise AssertionError("a table of pairs")

    for module in (pairs, rerank):
        for name in ("score_pairs", "labelled_pairs"):
            monkeypatch.setattr(module, name, made, raising=False)


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_no_table_of_pairs(spark, duck, no_pairs, name):
    df = registry.QUERIES[name](spark, SF)
    c = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda found: sorted(tuple(map(plain, r)) for r in found)
    assert rows(df.select(*names).collect()) == rows(c.fetchall())


@pytest.mark.parametrize("policy", ["market", "all_same_camera", "none"])
def test_per_query_with_copies_lone_queries_and_null_ids(spark, monkeypatch, policy):
    monkeypatch.setattr(rankings, "ASKED", 9)
    q, g = pairs.protocol(spark, SF)
    q = q.withColumn("id", F.when(F.col("key") % 35 == 0, F.lit(None)).otherwise(F.col("id")))
    g = g.where("key < 150").unionByName(g.where("key < 60").withColumn("key", F.col("key") + 1000).withColumn("cam", F.col("key") % 4))
    columns = ["q", "q_id", "status", "n_pos", "ap", "ap_trapezoid", "inp", "first", "top_g"]
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert rows(rankings.per_query(q, g, policy)) == rows(evaluate.per_query(q, g, pairs.labelled_pairs(q, g), policy))


def test_order_is_by_score_then_place_with_nan_first():
    import numpy as np

    assert list(rankings.descending(np.array([0.5, 0.9, np.nan, 0.5, 0.9]))) == [2, 1, 4, 0, 3]
    assert list(rankings.descending(np.array([0.1, 0.3, 0.2]))) == [1, 2, 0]


@pytest.mark.parametrize("values", [1, 3, 50, 5000])
def test_order_of_many_equal_scores(values):
    import numpy as np

    s = np.random.default_rng(values).integers(-values, values, 4000) / values
    assert np.array_equal(rankings.descending(s), np.argsort(-s, kind="stable"))


def test_grid_without_pairs(spark, no_pairs):
    points = registry.QUERIES["k8_parameter_grid"](spark, SF).collect()
    assert len(points) == 270 and sum(r["best"] for r in points) == 1


def test_few_units_are_drawn_from_in_many_tasks(spark):
    units = spark.createDataFrame([(k, k / 4) for k in range(4)], "unit long, s double").coalesce(1)
    drawn = stats.with_draws(units, ["unit"], 250)
    rows = drawn.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["unit"], r["draw"]) for r in rows) == [(k, n) for k in range(4) for n in range(1, 251)]
    assert len({r["task"] for r in rows}) > 4


def test_multiplicities_are_those_of_each_unit(spark, duck):
    rows = spark.createDataFrame([(n % 2 == 0, n % 3) for n in range(12)], "known boolean, id long")
    found = stats.multiplicities(rows, ["known", "id"], 130, 7)
    sql = f"WITH x AS (SELECT known, id, draw, {stats.uniform_sql('7', 'known', 'draw', 'id')} AS u FROM (VALUES (TRUE), (FALSE)) a(known), range(3) b(id), range(1, 131) c(draw)) SELECT known, id, draw, {stats.poisson1_sql('u')} AS k FROM x WHERE ({stats.poisson1_sql('u')}) > 0"
    assert sorted(map(tuple, found.select("known", "id", "draw", "k").collect())) == sorted(duck.execute(sql).fetchall())
