"""Mixing sources to target weights by fixed-length blocks.

Each source is one stream of words (its documents in a fixed order), cut into blocks of BLOCK words. The mix is a sequence of slots of
one block each, dealt to output shards. Every shard draws its counts of slots by source from a multinomial with the targets as weights;
the last of the shards' running totals are set right, so each source fills exactly the slots its target asks for. Slot k of a source takes
the block P_e(k mod n) in round e = k div n, where P_e is a pseudorandom permutation of the source's n blocks (a keyed Feistel network
walked back into range): within a round no block repeats. Blocks and slots are joined by their index, and each piece of a document says
which shard and slot it fills.

With more than MOST_SOURCES sources the same plan is made on executors: targets by rounds of sums, and the shards' counts by one keyed
permutation of all slots cut into equal parts, which is the multinomial draw conditioned on the totals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, documents, mix, named, stage, tidy

BLOCK = 1024
WEIGHTS = (5.0, 2.0, 1.0)
MOST_ROUNDS = 3
SEED = 17
SALTS = 256  # pieces that a source's prefix sums are cut into, so that a source with a third of all rows is no single task
SHARDS = 64
MOST_SOURCES = 100_000  # planned on the driver; more are planned on executors
SLOT_RUN = 100_000  # slots that one task makes at once


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST_ROUNDS) -> list[float]:
    """Shares of sum(sizes) by repeating weights, none above most * size: what is over is shared again by weight among the others."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out, left, total = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while left:
        unit = total / sum(w[k] for k in left)
        over = [k for k in left if unit * w[k] > most * sizes[k]]
        if not over:
            for k in left:
                out[k] = unit * w[k]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            total -= out[k]
        gone = set(over)
        left = [k for k in left if k not in gone]
    return out


def shard_counts(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard, [shards, sources]: multinomial draws whose totals are exactly `slots`.

    Shard by shard, the draw is over what each source still has to give (a multinomial conditioned on the totals), and the last shard
    takes the rest. The table has shards * sources cells, whatever the input.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        take = min(int(left.sum()), math.ceil(int(left.sum()) / (shards - k)))
        if take:
            draw = np.minimum(rng.multinomial(take, left / left.sum()), left)
            short = take - int(draw.sum())
            if short:  # a draw over a source's rest goes to the sources with most left
                room = np.argsort(-(left - draw), kind="stable")
                for r in room:
                    more = min(short, int((left - draw)[r]))
                    draw[r] += more
                    short -= more
                    if not short:
                        break
            out[k] = draw
            left = left - draw
    return out


def feistel(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 (or its inverse): four Feistel rounds over the smallest even number of bits that holds n, walked on
    while the value is out of range. The domain is under 4n, so the walk is short."""
    n = np.broadcast_to(np.asarray(n, np.uint64), np.shape(index))
    key = np.broadcast_to(np.asarray(key, np.uint64), np.shape(index))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(float), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            if back:
                left, right = right ^ (mix(left + k * np.uint64(4) + np.uint64(3 - r)) & m), left
            else:
                left, right = right, left ^ (mix(right + k * np.uint64(4) + np.uint64(r)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def slot_key(source, rounds):
    return (np.asarray(source, np.uint64) << np.uint64(20)) + np.asarray(rounds, np.uint64) * np.uint64(131) + np.uint64(SEED)


def slots_for(want: int, size: int, source: int, block: int) -> tuple[int, int]:
    """(slots, words that the last slot takes) for `want` words of a source of `size` words, want <= MOST_ROUNDS * size."""
    if not want or not size:
        return 0, 0
    n = -(-size // block)
    short = size - (n - 1) * block
    rounds, rest = divmod(want, size)
    if not rest:
        rounds, rest = rounds - 1, size
    place = int(feistel(np.array([n - 1]), n, slot_key([source], [rounds]), back=True)[0])  # of the short block in this round
    if rest <= place * block:
        slots, last = -(-rest // block), (rest - 1) % block + 1
    elif rest <= place * block + short:
        slots, last = place + 1, rest - place * block
    else:
        over = rest - place * block - short
        slots, last = place + 1 + -(-over // block), (over - 1) % block + 1
    return rounds * n + slots, last


def _deal(counts: np.ndarray, blocks: np.ndarray):
    """Global slot numbers -> (shard, source, k, round, index)."""
    import pyarrow as pa

    by_shard = np.r_[0, np.cumsum(counts.sum(1))]
    within = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, 1)], 1)
    before = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, 0)])

    def run(batches):
        for b in batches:
            g = b.column("id").to_numpy()
            shard = np.searchsorted(by_shard, g, "right") - 1
            at = g - by_shard[shard]
            source = np.zeros(len(g), np.int64)
            for k in np.unique(shard):
                m = shard == k
                source[m] = np.searchsorted(within[k], at[m], "right") - 1
            k = before[shard, source] + at - within[shard, source]
            n = blocks[source]
            rounds = k // n
            index = feistel(k % n, n, slot_key(source, rounds))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (shard, source, k, rounds, index)], ["shard", "source_no", "slot", "round", "index"])

    return run


def _plan_here(spark: SparkSession, found, block: int, weights, shards: int):
    """(per source: source_no, s_null, s_name, source_size, target, last_slot, last_words; slots: shard, source_no, slot, round, index)"""
    sizes = [r["source_size"] for r in found]
    goal = targets(sizes, weights)
    plan = [slots_for(int(math.floor(t + 0.5)), s, k, block) for k, (t, s) in enumerate(zip(goal, sizes, strict=True))]
    counts = shard_counts([p[0] for p in plan], shards)
    blocks = np.array([max(1, -(-s // block)) for s in sizes], np.int64)
    table = spark.createDataFrame([(k, r["s_null"], r["s_name"], r["source_size"], goal[k], plan[k][0] - 1, plan[k][1]) for k, r in enumerate(found)], "source_no long, s_null boolean, s_name string, source_size long, target double, last_slot long, last_words long")
    return table, spark.range(int(counts.sum())).mapInArrow(_deal(counts, blocks), "shard long, source_no long, slot long, round long, index long")


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order, from 0: ranges are sorted where they lie and numbered from the sizes of those before."""
    parts = max(2 * spark.sparkContext.defaultParallelism, 1)
    dealt = stage(spark, rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranges")
    sums = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    return dealt.join(F.broadcast(sums.select("part", "before")), "part").withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1 + F.col("before")).drop("part", "at", "before")


def _plan_there(spark: SparkSession, per: DataFrame, block: int, weights, shards: int):
    """As _plan_here, without a row of it on the driver."""
    import pyarrow as pa

    rows = numbered(spark, per, ["s_null", "s_name"], "source_no")
    rows = stage(spark, rows.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)).cast("int"))), "sources")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most = F.col("source_size") * MOST_ROUNDS
    unit, before = 0.0, -1
    while True:  # the unit only grows, and each round but the last finds a source that it fills
        full = (F.col("w") * unit > most) | (F.col("source_size") == 0)
        filled, gone, rest = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if filled == before or not rest:
            break
        unit, before = float(total - gone) / rest, filled
    rows = rows.withColumn("target", F.when(full, most.cast("double")).otherwise(F.col("w") * unit))

    def solve(batches):
        for b in batches:
            number, size, goal = (b.column(c).to_pylist() for c in ("source_no", "source_size", "target"))
            plan = [slots_for(int(math.floor(t + 0.5)), s, k, block) for k, s, t in zip(number, size, goal, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p[0] for p in plan], pa.int64()), pa.array([p[1] for p in plan], pa.int64())], [*b.schema.names, "n_slots", "last_words"])

    solved = rows.select("source_no", "s_null", "s_name", "source_size", "target").mapInArrow(solve, "source_no long, s_null boolean, s_name string, source_size long, target double, n_slots long, last_words long")
    solved = stage(spark, solved, "planned")
    n = solved.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    # where each source's slots begin among all, by the same numbering of runs of sources
    runs = solved.withColumn("run", F.expr("source_no div 1000")).groupBy("run").agg(F.sum("n_slots").alias("slots"))
    runs = runs.withColumn("lot", F.expr("run div 1000"))
    lots = runs.groupBy("lot").agg(F.sum("slots").alias("slots")).withColumn("l_base", F.coalesce(F.sum("slots").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per million sources
    runs = runs.join(lots.select("lot", "l_base"), "lot").withColumn("r_base", F.col("l_base") + F.coalesce(F.sum("slots").over(Window.partitionBy("lot").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    based = solved.withColumn("run", F.expr("source_no div 1000")).join(runs.select("run", "r_base"), "run")
    based = based.withColumn("base", F.col("r_base") + F.coalesce(F.sum("n_slots").over(Window.partitionBy("run").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = based.where("n_slots > 0").select("source_no", "source_size", "base", "n_slots", F.explode(F.expr(f"sequence(0, (n_slots - 1) div {SLOT_RUN})")).alias("first"))
    part = part.repartition("source_no", "first").select("source_no", "source_size", "base", F.explode(F.expr(f"sequence(first * {SLOT_RUN}, least(n_slots, (first + 1) * {SLOT_RUN}) - 1)")).alias("slot"))
    each = max(1, -(-n // shards))

    def deal(batches):
        for b in batches:
            source, size, base, slot = (b.column(c).to_numpy() for c in ("source_no", "source_size", "base", "slot"))
            blocks = -(-size // block)
            rounds = slot // blocks
            index = feistel(slot % blocks, blocks, slot_key(source, rounds))
            shard = feistel(base + slot, np.full(len(slot), n), np.full(len(slot), SEED)) // each
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (shard, source, slot, rounds, index)], ["shard", "source_no", "slot", "round", "index"])

    table = solved.select("source_no", "s_null", "s_name", "source_size", "target", (F.col("n_slots") - 1).alias("last_slot"), "last_words")
    return table, part.mapInArrow(deal, "shard long, source_no long, slot long, round long, index long")


def plan_mix(spark: SparkSession, sized: DataFrame, block: int = BLOCK, weights=WEIGHTS, shards: int = SHARDS, most_sources: int = MOST_SOURCES):
    """sized: row, doc_id, source, size, tie; a source's stream is in the hashed order of its ids, then by size and tie, however the rows
    lie -> (per source: s_null, s_name, source_size, target; pieces: row, shard, slot, round, lo, hi).

    A piece says that a slot of a shard, in round `round` of its source, takes words lo..hi-1 of the row (0-based, end exclusive).
    """
    key = [F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_name")]
    sized = sized.select("row", "doc_id", "size", "tie", *key)
    per = stage(spark, sized.groupBy("s_null", "s_name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    n_sources, n_rows = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = n_sources <= most_sources
    if few:
        table, slots = _plan_here(spark, per.orderBy("s_null", "s_name").collect(), block, weights, shards)
    else:
        table, slots = _plan_there(spark, per.drop("n"), block, weights, shards)

    # where each row stands in its source: sums of SALTS pieces, then within the piece
    salts = max(SALTS, -(-n_rows // 1_000_000))
    sent = F.broadcast(table) if few else table
    placed = sized.join(sent, ["s_null", "s_name"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    base = placed.groupBy("source_no", "salt").agg(F.sum("size").alias("words")).withColumn("base", F.sum("words").over(Window.partitionBy("source_no").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.coalesce(F.sum("size").over(Window.partitionBy("source_no", "salt").orderBy("doc_id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("at", at).join(base.select("source_no", "salt", F.coalesce("base", F.lit(0)).alias("base")), ["source_no", "salt"]).withColumn("start", F.col("base") + F.col("at"))
    cut = placed.where("size > 0").select("row", "size", "start", "source_no", "last_slot", "last_words", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("index"))
    joined = cut.join(slots, ["source_no", "index"])
    lo = F.greatest(F.lit(0), F.col("index") * block - F.col("start"))
    hi = F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start"), F.when(F.col("slot") == F.col("last_slot"), F.col("index") * block + F.col("last_words") - F.col("start")).otherwise(F.col("size")))
    pieces = joined.select("row", "source_no", "shard", "slot", "round", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    return table, pieces


def mix_sources(spark: SparkSession, docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, places (its pieces by shard: shard, slot, first and last word).

    A null text has size 0; a null source is a source of its own and the last. Rows without words take 0 and have no places. Repeated rows
    are rows of their own. Texts of any length are cut into blocks; extra columns are not read. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("tie")).withColumn("row", F.monotonically_increasing_id())
    sized = stage(spark, sized, "sized")
    table, pieces = plan_mix(spark, sized, block, weights, most_sources=most_sources)
    place = F.struct("shard", "source_no", "slot", "lo", "hi")
    taken = pieces.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.sort_array(F.collect_list(place)).alias("places"))
    named = sized.withColumn("s_null", F.col("source").isNull()).withColumn("s_name", F.coalesce("source", F.lit("")))
    named = named.join(table.select("s_null", "s_name", "source_size", "target"), ["s_null", "s_name"])
    said = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["shard"], p["slot"], p["lo"], p["hi"])), ",")
    return named.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(said, F.lit("")).alias("places"))


def mixed_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK, weights=WEIGHTS) -> DataFrame:
    """The mix itself with the columns of docs, whatever their names (the pipeline's stage): for each round the runs of words taken from a
    row, as rows.

    A run that covers its text stays as it is; any other is the text from its first to its last word, with n_chars set anew. Runs of
    neighbouring blocks stay one document, whichever shards their slots are in. Rows without words are not part of a mix.
    """
    import pyarrow as pa

    at = {c: docs.columns.index(c) for c in ("doc_id", "source", "text")}
    rows = stage(spark, apart(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    text = F.col(f"c{at['text']}")
    sized = rows.select("row", F.col(f"c{at['doc_id']}").alias("doc_id"), F.col(f"c{at['source']}").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    _, pieces = plan_mix(spark, sized, block, weights)
    runs = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("round", "lo", "hi"))).alias("runs"))
    joined = rows.join(runs, "row").drop("row")
    place, n = at["text"], len(docs.columns)

    def run(batches):
        import re

        word = re.compile("[^\x20\x09-\x0D]+")
        for b in batches:
            index, texts = [], []
            for k, (text, spans) in enumerate(zip(b.column(place).to_pylist(), b.column(n).to_pylist(), strict=True)):
                merged: list[list[int]] = []
                for s in spans:
                    if merged and merged[-1][0] == s["round"] and merged[-1][2] == s["lo"]:
                        merged[-1][2] = s["hi"]
                    else:
                        merged.append([s["round"], s["lo"], s["hi"]])
                ends = None
                for _, lo, hi in merged:
                    ends = ends or [m.span() for m in word.finditer(text)]
                    index.append(k)
                    texts.append(text if (lo, hi) == (0, len(ends)) else text[ends[lo][0] : ends[hi - 1][1]])
            index = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else b.column(k).take(index) for k in range(n)], b.schema.names[:n])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    out = joined.mapInArrow(tidy(run), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn(f"c{docs.columns.index('n_chars')}", F.length(text).cast("long"))
    return named(out, docs)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, documents(spark, sf_dir))
