"""Which passages stand in which texts, letter by letter, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
# The most keys that a broadcast may hold; beyond it the same joins are shuffled.
BROADCAST_KEYS = 500_000


def _words(text: Column) -> Column:
    return F.split(text, "\\s+")


def _grams(n: int) -> Column:
    """Hashes of all runs of n elements of the column w."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)])))


def contained(passages: DataFrame, texts: DataFrame, p_id: str, p_text: str, t_id: str, t_text: str) -> DataFrame:
    """(p_id, t_id): one row for each passage and each row of texts that contains it. Null texts and passages take no part.

    The words inside a passage, without its first and last, which may be part of longer words, stand in the text as words of their own. Up
    to GRAM of them are the key that finds the candidates; each candidate is then compared as a whole. Passages of one or two words have
    no such key and are looked for in every text.
    """
    known = passages.select(F.col(p_id).alias("p"), F.col(p_text).alias("passage")).where("passage IS NOT NULL")
    known = known.withColumn("w", _words(F.col("passage"))).withColumn("n", F.least(F.lit(GRAM), F.size("w") - 2))
    lengths = {r["n"]: r["count"] for r in known.groupBy("n").count().collect()}  # at most GRAM + 2 rows
    few = sum(lengths.values()) <= BROADCAST_KEYS
    send = F.broadcast if few else lambda df: df
    rows = texts.select(F.col(t_id).alias("t"), F.col(t_text).alias("body"))
    # explode(array(x)) keeps the words as a column: the lambdas read it and do not split again
    words = rows.select("t", F.explode(F.array(_words(F.col("body")))).alias("w"))
    found = []
    for n in sorted(k for k in lengths if k > 0):
        keys = known.where(F.col("n") == n).select("p", "passage", F.xxhash64(*[F.get("w", F.lit(k)) for k in range(1, n + 1)]).alias("key"))
        near = words.select("t", F.explode(_grams(n)).alias("key")).join(send(keys.select("p", "key")), "key").select("p", "t").distinct()
        found.append(near.join(send(keys.select("p", "passage")), "p").join(rows, "t").where(F.contains("body", "passage")).select("p", "t"))
    if any(k <= 0 for k in lengths):
        short = known.where("n <= 0").select("p", "passage")
        found.append(rows.join(send(short), F.contains("body", "passage")).select("p", "t"))
    if not found:
        return known.join(rows.limit(0), F.lit(False)).select(F.col("p").alias(p_id), F.col("t").alias(t_id))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.select(F.col("p").alias(p_id), F.col("t").alias(t_id))
