"""Passages in texts against plain containment."""

import random

from vecsift.operators.containment import contained


def test_contained_against_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "b", "bc", "c"]
    line = lambda k: rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(k)) + rng.choice(["", " "])
    texts = [(k, line(rng.randint(0, 40))) for k in range(60)] + [(60, None), (61, ""), (7, "a b c ab abc bc"), (7, "a b c ab abc bc")]
    cut = []
    for k in range(80):
        t = rng.choice([x for _, x in texts if x])
        a = rng.randrange(len(t))
        cut.append((k, t[a : a + rng.randint(1, 25)]))  # first and last words are often cut within
    passages = cut + [(100, "a"), (101, "ab abc"), (102, "a b c"), (103, "a b c ab"), (104, "b c ab abc b"), (105, "b c ab abc bc"), (106, ""), (107, None), (108, "no such words here at all")]
    got = sorted(map(tuple, contained(spark.createDataFrame(passages, "i long, p string"), spark.createDataFrame(texts, "d long, x string"), "i", "p", "d", "x").collect()))
    assert got == sorted((i, d) for i, p in passages for d, x in texts if p is not None and x is not None and p in x)


def test_contained_plan_splits_once(spark):
    b, d = spark.createDataFrame([(1, "a b c d e f")], "i long, p string"), spark.createDataFrame([(1, "x a b c d e f")], "d long, x string")
    assert contained(b, d, "i", "p", "d", "x").count() == 1
    assert contained(b.where("false"), d, "i", "p", "d", "x").count() == 0
