"""Registered queries over the relational tables: sources, filters, joins, sets, aggregates, integrity and splits."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import vectors as V
from ..operators import containment
from ..operators import integrity as I
from ..operators import pairs as P
from ..sources import readers, sinks
from .retrieval import all_rows, r6

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def folder(spark) -> str:
    """A new path in the folder that all executors share."""
    from ..streaming.retrieval import shared_folder

    return shared_folder(spark)


# ---- sources and sinks: written to the shared folder and read back ------------------------------------------------------------


BOXES = "SELECT l_orderkey * 10 + l_linenumber AS key, (l_partkey % 200)::INT AS x, (l_suppkey % 150)::INT AS y, (l_quantity::INT % 40) + 5 AS w, (l_linenumber * 7 % 30) + 5 AS h FROM lineitem"


def boxes(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_partkey") % 200).cast("int").alias("x"), (F.col("l_suppkey") % 150).cast("int").alias("y"), (F.col("l_quantity").cast("int") % 40 + 5).alias("w"), (F.col("l_linenumber") * 7 % 30 + 5).alias("h"))


@query("s1_read_rows", f"WITH b AS ({BOXES}) SELECT key::VARCHAR AS image_id, x, y, w, h FROM b")
def s1(spark, d):
    path = folder(spark)
    boxes(spark, d).select(F.col("key").cast("string").alias("image_id"), F.lit("?").alias("extra"), "x", "y", "w", "h").write.csv(path, header=True)
    return readers.read_rows(spark, path).drop("row_no")


@query("s2_read_meta", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def s2(spark, d):
    path = folder(spark)
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").write.csv(path, header=True)
    return readers.read_meta(spark, path)


@query("s3_read_npy", "SELECT i AS row_no, 4.0::DOUBLE * i AS first FROM range(50) t(i)")
def s3(spark, d):
    import numpy as np

    shared = folder(spark).removeprefix("file:").replace("///", "/")  # NumPy files need a shared folder that is mounted
    os.makedirs(shared, exist_ok=True)
    path = os.path.join(shared, "m.npy")
    np.save(path, np.arange(200.0).reshape(50, 4))  # a fixture of its own: the format is what is read
    spark.dataSource.register(readers.NpyDataSource)
    return spark.read.format("npy").option("path", path).option("rows", 20).load().select("row_no", F.element_at("v", 1).alias("first"))


@query("s5_file_scan")
def s5(spark, d):
    path = folder(spark)
    table(spark, d, "region").repartition(2).write.json(path)
    return readers.file_scan(spark, path).where("path LIKE '%.json'").select("bytes", F.length("md5").alias("digits"))


@query("s6_jsonl", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def s6(spark, d):
    path = folder(spark)
    table(spark, d, "conversations").write.json(path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("s7_report_keys", "SELECT event_type, sum((props->>'$.k')::INT) AS k FROM events GROUP BY event_type")
def s7(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


@query("s8_resolve_files", "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || '.jpg' WHEN s_suppkey % 3 = 1 THEN s_suppkey || '.png' END AS path FROM supplier")
def s8(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    files = s.where("id % 3 = 0").select(F.concat("id", F.lit(".jpg")).alias("path")).union(s.where("id % 3 < 2").select(F.concat("id", F.lit(".png")).alias("path")))
    return readers.resolve_files(s, files)


@query("s14_embedding_rows", "SELECT (vec_id % 5 <> 0)::INT AS part, vec_id AS key, len(embedding) AS size FROM embeddings WHERE vec_id % 5 = 0 OR label < 8")
def s14(spark, d):
    return sinks.embedding_rows(*P.protocol(spark, d)).select("part", "key", F.size("v").cast("long").alias("size"))


@query("s16_s18_published_tables", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def s16(spark, d):
    path = folder(spark) + "-published"
    n = table(spark, d, "nation")
    sinks.publish(spark, {"nation": (n.select("n_nationkey", "n_name"), {"header": True}), "region": (table(spark, d, "region"), {"header": False})}, path)
    return spark.read.csv(f"{path}/nation", header=True)


@query("s20_one_match_catalogue", "SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_name HAVING count(*) = 1")
def s20(spark, d):
    p = table(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "PROMO"))
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


# ---- filters and geometry -----------------------------------------------------------------------------------------------------


@query("f3_f4_box_problems", f"WITH b AS ({BOXES}) SELECT count(*) FILTER (WHERE w > 0 AND h > 0 AND x < 180 AND y < 140) AS intersects, count(*) FILTER (WHERE x + w <= 180 AND y + h <= 140) AS inside, count(*) FILTER (WHERE NOT (x + w <= 180 AND y + h <= 140)) AS problems FROM b")
def f3(spark, d):
    inside = F.expr("x + w <= 180 AND y + h <= 140")
    return boxes(spark, d).agg(F.count_if(F.expr("w > 0 AND h > 0 AND x < 180 AND y < 140")).alias("intersects"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("problems"))


@query("f10_f11_box_geometry", f"WITH b AS ({BOXES}) SELECT key, x - floor(0.03 * w + 0.5)::INT AS x_out, w + 2 * floor(0.03 * w + 0.5)::INT AS w_out, round(w * h / (180.0 * 140.0), 6) AS share, round(w / h::DOUBLE, 6) AS aspect, x <= 0 OR y <= 0 OR x + w >= 180 OR y + h >= 140 AS touches FROM b")
def f10(spark, d):
    grow = F.floor(F.lit(0.03) * F.col("w") + 0.5).cast("int")
    return boxes(spark, d).select("key", (F.col("x") - grow).alias("x_out"), (F.col("w") + 2 * grow).alias("w_out"), r6(F.col("w") * F.col("h") / (180.0 * 140.0), "share"), r6(F.col("w") / F.col("h"), "aspect"), F.expr("x <= 0 OR y <= 0 OR x + w >= 180 OR y + h >= 140").alias("touches"))


@query("f12_pair_categories", "SELECT CASE WHEN a.c_nationkey = b.c_nationkey THEN 'same' ELSE 'other' END AS nation, a.c_mktsegment AS segment, count(*) AS n FROM customer a JOIN customer b ON a.c_custkey + 1 = b.c_custkey GROUP BY ALL")
def f12(spark, d):
    c = table(spark, d, "customer")
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_nationkey").alias("other"))
    return c.join(b, "c_custkey").groupBy(F.when(F.col("c_nationkey") == F.col("other"), "same").otherwise("other").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins and sets -------------------------------------------------------------------------------------------------------------


BANDS = "SELECT p_partkey AS key, p_partkey % 211 AS x, p_size AS y, length(p_name) AS w, p_partkey % 37 AS h FROM part"


@query("j4_band_join", f"WITH b AS ({BANDS}) SELECT l.key AS a, r.key AS b FROM b l JOIN b r ON l.key < r.key AND abs(l.x - r.x) <= 5 AND abs(l.y - r.y) <= 5 AND abs(l.w - r.w) <= 5 AND abs(l.h - r.h) <= 5")
def j4(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 211).alias("x"), F.col("p_size").alias("y"), F.length("p_name").alias("w"), (F.col("p_partkey") % 37).alias("h"))
    return P.band_join(b, b, ["x", "y", "w", "h"], 5).where("a < b")


@query("j6_metadata_join", "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def j6(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("j7_semi_join", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j7(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("j8_anti_joins", "SELECT 'unlabelled' AS side, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'no document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def j8(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    gone = lambda x, y, name: x.join(y, "doc_id", "left_anti").agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return gone(a, b, "unlabelled").unionByName(gone(b, a, "no document"))


@query("j12_reconciliation", "WITH e AS (SELECT p_partkey, p_size FROM part), f AS (SELECT p_partkey + (p_partkey % 97 = 0)::INT * 100000 AS p_partkey, p_size + (p_partkey % 89 = 0)::INT AS p_size FROM part) SELECT coalesce(e.p_partkey, f.p_partkey) AS p_partkey, CASE WHEN f.p_partkey IS NULL THEN 'missing' WHEN e.p_partkey IS NULL THEN 'extra' ELSE 'p_size' END AS problem FROM e FULL JOIN f ON e.p_partkey = f.p_partkey WHERE e.p_partkey IS NULL OR f.p_partkey IS NULL OR e.p_size <> f.p_size")
def j12(spark, d):
    e = table(spark, d, "part").select("p_partkey", "p_size")
    f = e.select((F.col("p_partkey") + F.when(F.col("p_partkey") % 97 == 0, 100000).otherwise(0)).alias("p_partkey"), (F.col("p_size") + (F.col("p_partkey") % 89 == 0).cast("int")).alias("p_size"))
    return I.reconcile(e, f, "p_partkey", ["p_size"])


@query("o1_o5_set_report", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier), x AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k) SELECT count(l) AS n_left, count(r) AS n_right, count(*) AS n_union, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_both, count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right FROM x")
def o1(spark, d):
    return I.set_report(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("o2_intersect", "SELECT l_partkey % 500 AS k FROM lineitem INTERSECT SELECT p_partkey % 700 FROM part")
def o2(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("k")).intersect(table(spark, d, "part").select((F.col("p_partkey") % 700).alias("k")))


@query("o3_benchmark_leakage", "SELECT b.item_id, count(*) AS n_documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def o3(spark, d):
    """Which benchmark passages stand in a document."""
    pairs = containment.contained(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


@query("o4_except_both_ways", "(SELECT 'customers' AS only_in, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)) UNION ALL (SELECT 'orders', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer))")
def o4(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).select(F.lit("customers").alias("only_in"), "k").unionByName(b.subtract(a).select(F.lit("orders").alias("only_in"), "k"))


# ---- aggregates -----------------------------------------------------------------------------------------------------------------


@query("a1_column_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, '{k}' AS kind, count(DISTINCT {c}) AS n_unique, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high, min(length({c}::VARCHAR)) AS shortest, max(length({c}::VARCHAR)) AS longest FROM part" for c, k in (("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "int"))))
def a1(spark, d):
    return I.column_profile(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query("a2_duplicate_counts", "SELECT count(*) - count(DISTINCT l_orderkey) AS repeated, max(n) AS most FROM lineitem JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (l_orderkey)")
def a2(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return g.agg((F.sum("n") - F.count(F.lit(1))).alias("repeated"), F.max("n").alias("most"))


@query("a3_count_of_counts", "SELECT n AS items, count(*) AS orders FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n")
def a3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("orders"))


@query("a4_a5_quantiles", "SELECT event_type, round(min(value), 6) AS low, round(median(value), 6) AS mid, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS high FROM events GROUP BY event_type")
def a4(spark, d):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    e = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("a"), q.alias("q"), F.max("value").alias("z"))
    return e.select("event_type", r6("a", "low"), r6(F.col("q")[0], "mid"), r6(F.col("q")[1], "p95"), r6("z", "high"))


@query("a6_share_of_rows", "SELECT l_returnflag, round(avg((l_discount > 0.05)::INT), 6) AS share FROM lineitem GROUP BY l_returnflag")
def a6(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg((F.col("l_discount") > 0.05).cast("int")), "share"))


@query("a7_duplicate_groups", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first, string_agg(DISTINCT (doc_id % 3)::VARCHAR, '+' ORDER BY (doc_id % 3)::VARCHAR) AS sides FROM documents GROUP BY 1 HAVING count(*) > 1")
def a7(spark, d):
    x = table(spark, d, "documents").withColumn("side", (F.col("doc_id") % 3).cast("string"))
    return I.duplicate_groups(x, F.col("text"), "doc_id", "side")


@query("a8_threshold_cube", "SELECT l_returnflag, l_linestatus, t, count(*) FILTER (WHERE l_quantity >= t) AS n FROM lineitem, (SELECT unnest([10, 25, 40]) AS t) GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, t), (l_returnflag, t), (t))")
def a8(spark, d):
    cell = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_quantity") >= 10).alias("a"), F.count_if(F.col("l_quantity") >= 25).alias("b"), F.count_if(F.col("l_quantity") >= 40).alias("c"))
    sets = cell.rollup("l_returnflag", "l_linestatus").agg(*[F.sum(x).alias(x) for x in "abc"])
    return sets.select("l_returnflag", "l_linestatus", F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(x).alias("n")) for t, x in ((10, "a"), (25, "b"), (40, "c"))])))


@query("a9_distinct_count", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def a9(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("a17_top_share", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC, event_id) AS k, count(*) OVER () AS n FROM events WHERE value > 0) SELECT round(sum(value) FILTER (WHERE k <= ceil(0.1 * n)) / sum(value), 6) AS share FROM r")
def a17(spark, d):
    """The top tenth by distinct value: ties at the edge are split by count, so no single ordered window over all rows is needed."""
    e = table(spark, d, "events").where("value > 0").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    t = e.agg(F.sum("n").alias("total"), F.sum(F.col("value") * F.col("n")).alias("all"))
    x = e.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).crossJoin(F.broadcast(t))
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("total") * 0.1) - F.col("before")))
    return x.agg(r6(F.sum(F.col("value") * take) / F.max("all"), "share"))


@query("a18_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def a18(spark, d):
    return table(spark, d, "lineitem").agg(r6(F.corr("l_quantity", "l_extendedprice"), "r"))


@query("a19_mean_std_sem", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM events GROUP BY event_type")
def a19(spark, d):
    s = F.stddev_samp("value")
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value"), "mean"), r6(s, "std"), r6(s / F.sqrt(F.count(F.lit(1))), "sem"))


@query("a21_grid_bands", "SELECT label, i < 17 OR i > 48 AS edge, round(avg(abs(embedding[i])), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, edge")
def a21(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding"))
    return x.groupBy("label", ((F.col("pos") < 16) | (F.col("pos") > 47)).alias("edge")).agg(r6(F.avg(F.abs(F.col("col").cast("double"))), "mean"))


@query("a22_latency_summary", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) / sum(value), 6) AS rate FROM events WHERE value > 0 GROUP BY event_type")
def a22(spark, d):
    e = table(spark, d, "events").where("value > 0").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), (F.count(F.lit(1)) / F.sum("value")).alias("r"))
    return e.select("event_type", r6(F.col("q")[0], "p50"), r6(F.col("q")[1], "p95"), r6("r", "rate"))


@query("a23_argmax_row", "SELECT l_returnflag, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -l_orderkey, -l_linenumber)) AS best FROM lineitem GROUP BY l_returnflag")
def a23(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max_by(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("best"))


@query("a24_window_map", f"WITH b AS ({BOXES}) SELECT x // 20 + i AS col, y // 20 + j AS row, count(*) AS n, round(avg(w * h), 6) AS mean FROM b, range(0, 2) s(i), range(0, 2) t(j) GROUP BY ALL")
def a24(spark, d):
    b = boxes(spark, d).select(F.expr("x div 20").alias("c"), F.expr("y div 20").alias("r"), (F.col("w") * F.col("h")).alias("a"))
    cells = b.select("a", "c", "r", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("a", "c", "r", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return cells.groupBy((F.col("c") + F.col("i")).alias("col"), (F.col("r") + F.col("j")).alias("row")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("a"), "mean"))


@query("a25_markdown_table", "WITH g AS (SELECT o_orderpriority AS p, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1) SELECT string_agg('| ' || p || ' | ' || printf('%.2f', m) || ' |', chr(10) ORDER BY p) AS body FROM g")
def a25(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("m"))
    line = F.format_string("| %s | %.2f |", "o_orderpriority", "m")
    return g.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderpriority", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))  # one line per priority


@query("w10_first_per_key", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def w10(spark, d):
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("k", n).where("k <= 2").select("l_partkey", "l_orderkey", "l_linenumber")


@query("w13_global_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def w13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("w5_lagged_differences", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def w5(spark, d):
    return table(spark, d, "events").select("event_id", r6(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), "step"))


# ---- integrity and splits ---------------------------------------------------------------------------------------------------------


@query("i3_structure_comparison", "SELECT side, count(*) AS n, count(DISTINCT c_nationkey) AS groups, round(avg(c_acctbal), 6) AS mean FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'held' ELSE 'fit' END AS side FROM customer) GROUP BY side")
def i3(spark, d):
    c = table(spark, d, "customer").withColumn("side", F.when(F.col("c_custkey") % 4 == 0, "held").otherwise("fit"))
    return c.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("groups"), r6(F.avg("c_acctbal"), "mean"))


@query("i5_number_audit", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+')) AS token FROM documents) SELECT doc_id, count(*) AS n, max(length(token)) AS longest FROM t GROUP BY doc_id")
def i5(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("token"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("token")).alias("longest"))


@query("i6_table_diff", "SELECT vec_id AS key FROM embeddings WHERE vec_id % 50 = 7")
def i6(spark, d):
    a = all_rows(spark, d).select("key", "id", "v")
    b = a.withColumn("v", F.when(F.col("key") % 50 == 7, F.transform("v", lambda x: x + 0.001)).otherwise(F.col("v")))
    return I.table_diff(a, b, "key")


@query("m24_report_diff", "WITH a AS (SELECT event_type AS path, round(sum(value), 4) AS a FROM events GROUP BY 1) SELECT path, a, a + 0.5 AS b FROM a WHERE path > 'd'")
def m24(spark, d):
    a = table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.round(F.sum("value"), 4).alias("value"))
    b = a.withColumn("value", F.when(F.col("path") > "d", F.col("value") + 0.5).otherwise(F.col("value")))
    return I.report_diff(a, b)


@query("i8_consolidated_reports", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events) AS events")
def i8(spark, d):
    one = lambda t: table(spark, d, t).agg(F.count(F.lit(1)).alias(t))
    return one("documents").crossJoin(one("pages")).crossJoin(one("events"))  # one row each


@query("i9_reproducibility_gate", "SELECT count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]+$')) AS odd_names FROM customer")
def i9(spark, d):
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("c_name").rlike("^Customer#[0-9]+$")).alias("odd_names"))


@query("i1_split_violations", """WITH e AS (SELECT vec_id AS key, label AS id, (vec_id // 5) % 4 AS cam FROM embeddings),
a AS (SELECT key, id, cam, CASE WHEN id >= 6 THEN 'fit' WHEN key % 5 = 0 THEN 'query' WHEN id < 4 THEN 'gallery' ELSE 'unused' END AS role FROM e),
g AS (SELECT * FROM a WHERE role = 'gallery'), q AS (SELECT *, id < 4 AS known FROM a WHERE role = 'query')
SELECT 'S0' AS rule, 0::BIGINT AS n UNION ALL
SELECT 'P1', count(*) FROM (SELECT id FROM a WHERE role <> 'unused' GROUP BY id HAVING count(DISTINCT role = 'fit') > 1) UNION ALL
SELECT 'P2', count(*) FROM q WHERE known AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = q.id AND g.cam <> q.cam) UNION ALL
SELECT 'P3', count(*) FROM q WHERE known <> (id IN (SELECT id FROM g))""")
def i1(spark, d):
    e = all_rows(spark, d).select("key", "id", "cam")
    role = F.when(F.col("id") >= 6, "fit").when(F.col("key") % 5 == 0, "query").when(F.col("id") < 4, "gallery").otherwise("unused")
    return I.split_violations(e, e.select("key", role.alias("role"), (F.col("id") < 4).alias("known")))


@query("i2_corrupted_split", "WITH e AS (SELECT label AS id, (vec_id // 5) % 4 AS cam, vec_id AS key FROM embeddings) SELECT count(*) AS p1_breaks FROM (SELECT id FROM e GROUP BY id HAVING count(*) > 1)")
def i2(spark, d):
    e = all_rows(spark, d).select("key", "id", "cam")
    broken = e.select("key", F.when(F.row_number().over(Window.partitionBy("id").orderBy("key")) == 1, "query").otherwise("fit").alias("role"), F.lit(False).alias("known"))
    return I.split_violations(e, broken).where("rule = 'P1'").select(F.col("n").alias("p1_breaks"))


@query("p4_first_frame_split", "SELECT vec_id AS key, CASE WHEN row_number() OVER (PARTITION BY label, (vec_id // 5) % 4 ORDER BY vec_id) = 1 THEN 'gallery' ELSE 'query' END AS role FROM embeddings")
def p4(spark, d):
    return I.first_frame_split(all_rows(spark, d), "key", "id", "cam").select("key", "role")


@query("p5_capped_protocol", "SELECT key FROM (SELECT vec_id AS key, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id)) AS n FROM embeddings) WHERE n <= 3")
def p5(spark, d):
    return I.capped(all_rows(spark, d), "id", "key", 3).select("key")


@query("p6_group_disjoint_split", "SELECT c_custkey, CASE WHEN ('0x' || substr(md5('0|' || c_nationkey), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'held' ELSE 'fit' END AS side FROM customer")
def p6(spark, d):
    return I.group_split(table(spark, d, "customer"), "c_nationkey", 0.3).select("c_custkey", "side")


@query("p10_error_sample", "SELECT vec_id AS key FROM embeddings WHERE label >= 8 ORDER BY md5('0|' || vec_id) LIMIT 12")
def p10(spark, d):
    return all_rows(spark, d).where("id >= 8").orderBy(I.hashed_order("key")).limit(12).select("key")


@query("p11_synthetic_gallery")
def p11(spark, d):
    from ..operators.ivf import extended

    return extended(P.protocol(spark, d)[1], 1000).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(V.norm(F.col("v"))), "norm"))
