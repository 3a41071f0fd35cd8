"""The corpus pipeline: documents pass the stages in order, each on all that its predecessor kept.

quality (rejected documents go) -> exact dedup (one of equal texts stays) -> n-gram Jaccard join (one document of each group stays) ->
mixing (the runs of words that the mix takes, as documents) -> packing (the pieces of sequences). All stages but the last return the
columns of documents; empty tables pass through.
"""

from __future__ import annotations

from vecsift.llm import exact_dedup, jaccard_join, mixing, packing, quality
from vecsift.llm.common import documents, stage

#: Less than packing alone remembers: the executors still hold what the stages before have left.
CACHED_WORDS = 250_000

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.keep_good(spark, docs, sf_dir)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.keep_one(spark, docs)),
    ("ngram_jaccard", lambda spark, docs, sf_dir: jaccard_join.keep_one(spark, docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed_documents(spark, docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(spark, docs, cached=CACHED_WORDS, chunk=1 << 20)),
]

#: A learnt classifier and a tokenizer take part: SQL cannot state the result. tests/llm holds it against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
