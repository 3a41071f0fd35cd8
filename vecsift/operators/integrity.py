"""Profiles, duplicates, set comparisons, manifests, splits and their validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: kind, n_unique, low, high, shortest, longest; one pass over the table."""
    aggs = []
    for c in df.columns:
        s = F.col(c).cast("string")
        aggs += [F.count_distinct(c).alias(f"{c}__u"), F.min(c).cast("string").alias(f"{c}__a"), F.max(c).cast("string").alias(f"{c}__z"), F.min(F.length(s)).alias(f"{c}__s"), F.max(F.length(s)).alias(f"{c}__l")]
    kinds = dict(df.dtypes)
    whole = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("name"), F.lit("int" if kinds[c] in ("int", "bigint") else "str").alias("kind"), F.col(f"{c}__u").alias("n_unique"), F.col(f"{c}__a").alias("low"), F.col(f"{c}__z").alias("high"), F.col(f"{c}__s").alias("shortest"), F.col(f"{c}__l").alias("longest")) for c in df.columns]
    return whole.select(F.inline(F.array(*rows)))


def duplicate_groups(df: DataFrame, content: Column, key: str, side: str | None = None) -> DataFrame:
    """Groups of equal content of two or more: digest, n, first key, and the pattern of the sides they are on."""
    g = df.groupBy(F.md5(content).alias("digest"))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), *([F.array_join(F.sort_array(F.collect_set(side)), "+").alias("sides")] if side else []))
    return out.where("n > 1")


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of both sets, their union, intersection and differences, in one grouped pass."""
    x = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return x.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.lit(1)).alias("n_union"), F.count_if(both).alias("n_both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def reconcile(expected: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and problem: missing, extra, or the first field that differs."""
    e = expected.select(key, F.lit(True).alias("in_e"), *[F.col(c).alias(f"e_{c}") for c in fields])
    f = found.select(key, F.lit(True).alias("in_f"), *[F.col(c).alias(f"f_{c}") for c in fields])
    problem = F.when(F.col("in_f").isNull(), "missing").when(F.col("in_e").isNull(), "extra")
    for c in fields:
        problem = problem.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"f_{c}")), c)
    return e.join(f, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def table_diff(left: DataFrame, right: DataFrame, key: str, atol: float = 1e-6) -> DataFrame:
    """Row-by-row differences: other fields must be equal, vectors (v) close in every component."""
    fields = [c for c in left.columns if c not in (key, "v")]
    bad = [~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in fields]
    if "v" in left.columns:
        bad.append(~F.coalesce((F.size("l.v") == F.size("r.v")) & F.forall(F.zip_with("l.v", "r.v", lambda a, b: F.abs(a - b) <= atol), lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False)))
    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    gone = F.col(f"l.{key}").isNull() | F.col(f"r.{key}").isNull()
    return j.where(reduce(lambda a, b: a | b, bad, gone)).select(F.coalesce(f"l.{key}", f"r.{key}").alias(key))


def report_diff(left: DataFrame, right: DataFrame, atol: float = 1e-9) -> DataFrame:
    """path, a, b of two flattened reports (path, value): whole numbers must be equal, others within atol."""
    j = left.select("path", F.col("value").alias("a")).join(right.select("path", F.col("value").alias("b")), "path", "full")
    whole = (F.col("a") == F.floor("a")) & (F.col("b") == F.floor("b"))
    same = F.when(whole, F.col("a") == F.col("b")).otherwise(F.abs(F.col("a") - F.col("b")) <= atol)
    return j.where(~F.coalesce(same, F.col("a").isNull() & F.col("b").isNull()))


# ---- splits ------------------------------------------------------------------------------------------------------------------


def hashed_order(*key: str, seed: str = "0") -> Column:
    """A reproducible random order that any engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))


def group_split(rows: DataFrame, group: str, share: float, seed: str = "0") -> DataFrame:
    """Whole groups go to one side: side is 'held' for the share of groups whose digest starts low."""
    u = F.conv(F.substring(hashed_order(group, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("side", F.when(u < share, "held").otherwise("fit"))


def first_frame_split(rows: DataFrame, key: str, group: str, camera: str) -> DataFrame:
    """The first row of each (group, camera) is the gallery, all others are queries."""
    n = F.row_number().over(Window.partitionBy(group, camera).orderBy(key))
    return rows.withColumn("role", F.when(n == 1, "gallery").otherwise("query"))


def quota_split(rows: DataFrame, key: str, group: str, camera: str, quotas: dict[str, float], seed: str = "0") -> DataFrame:
    """Groups in a hashed order fill the roles' shares of rows; of a gallery group, one row per camera stays and the rest is unused."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("o", hashed_order(group, seed=seed))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    run = F.sum("n").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)) / total
    role, edge = F.lit(None).cast("string"), 0.0
    for name, share in quotas.items():
        edge += share
        role = F.coalesce(role, F.when(run <= edge + 1e-9, name))
    placed = rows.join(sizes.withColumn("role", F.coalesce(role, F.lit("unused"))).select(group, "role"), group)
    n = F.row_number().over(Window.partitionBy(group, camera).orderBy(hashed_order(key, seed=seed)))
    return placed.withColumn("role", F.when((F.col("role") == "gallery") & (n > 1), "unused").otherwise(F.col("role")))


def capped(rows: DataFrame, group: str, key: str, most: int, seed: str = "0") -> DataFrame:
    """At most `most` rows of each group, in a hashed order (a sampling operator)."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(hashed_order(key, seed=seed)))
    return rows.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def batch_plan(rows: DataFrame, key: str, group: str, camera: str, people: int, each: int, seed: str = "0") -> DataFrame:
    """batch, key: batches of `people` groups with `each` rows, taking a group's cameras in turn so that a batch sees several."""
    turn = F.row_number().over(Window.partitionBy(group, camera).orderBy(hashed_order(key, seed=seed)))
    picked = rows.withColumn("turn", turn).withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("turn", hashed_order(camera, seed=seed)))).where(F.col("n") <= each)
    order = picked.select(group).distinct().withColumn("batch", F.floor((F.row_number().over(Window.orderBy(hashed_order(group, seed=seed))) - 1) / people))
    return picked.join(order, group).select("batch", key, group, camera)


def split_violations(rows: DataFrame, assignment: DataFrame, key: str = "key", group: str = "id", camera: str = "cam", content: str | None = None) -> DataFrame:
    """rule, n: S0 coverage (a row without a role, or a role without a row), P1 ids on both sides of fit and evaluation, P2 known queries
    without a gallery mate under another camera, P3 the known flag is not the truth, P4 equal content on both sides. Rules that hold have 0."""
    j = rows.join(assignment, key, "full")
    whole = rows.join(assignment, key)
    s0 = j.where(F.col("role").isNull() | F.col(group).isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("S0").alias("rule"), "n")
    side = F.when(F.col("role") == "fit", 0).otherwise(1)
    p1 = whole.where("role <> 'unused'").groupBy(group).agg(F.count_distinct(side).alias("k")).agg(F.count_if(F.expr("k > 1")).alias("n")).select(F.lit("P1").alias("rule"), "n")
    g = whole.where("role = 'gallery'").select(F.col(group).alias("g_group"), F.col(camera).alias("g_cam"))
    q = whole.where("role = 'query'")
    mate = q.join(g, (F.col(group) == F.col("g_group")) & (F.col(camera) != F.col("g_cam")), "left_semi").select(key).withColumn("mate", F.lit(True))
    q = q.join(mate, key, "left").join(g.select("g_group").distinct().withColumn("there", F.lit(True)), F.col(group) == F.col("g_group"), "left")
    p2 = q.agg(F.count_if(F.coalesce("known", F.lit(False)) & F.col("mate").isNull()).alias("n")).select(F.lit("P2").alias("rule"), "n")
    p3 = q.agg(F.count_if(~F.coalesce("known", F.lit(False)).eqNullSafe(F.col("there").isNotNull())).alias("n")).select(F.lit("P3").alias("rule"), "n")
    out = s0.unionByName(p1).unionByName(p2).unionByName(p3)
    if content:
        p4 = whole.where("role <> 'unused'").groupBy(content).agg(F.count_distinct(side).alias("k")).agg(F.count_if(F.expr("k > 1")).alias("n")).select(F.lit("P4").alias("rule"), "n")
        out = out.unionByName(p4)
    return out
