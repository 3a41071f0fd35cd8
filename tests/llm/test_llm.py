"""The corpus operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsift.llm import components, exact_dedup, jaccard_join, licenses, mixing, packing, pii, quality, suffix_dedup, toxicity, vptree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, row string, id string"  # with clashing names
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def corpus(seed=3, n=120):
    """Texts with exact and near copies, a shared passage, empty, null, short, repetitive and long ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, out = text(60), []
    for k in range(n):
        t = text(rng.randint(1, 120))
        if out and k % 4 == 1:
            t = rng.choice([x for x in out if x] or [t])
        elif out and k % 4 == 2:
            w = (rng.choice([x for x in out if x] or [t])).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif k % 7 == 3:
            t = f"{text(20)} {passage} {text(9)}"
        out.append(t)
    out += [None, "", " \n\t", "one", "one two three four", "ONE two three four", "ab " * 400, "ab " * 400 + "x", "x" * 49, "x" * 50, "x" * 60, text(4000)]
    return [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", 0, "a", "b", "c", "d") for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent, links = {i: i for i in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [2, 1500])
def test_jaccard_against_brute_force(spark, docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(spark, docs).collect()}
    assert got == jaccard_brute(corpus())
    kept = {r["doc_id"] for r in jaccard_join.keep_one(spark, docs).collect()}
    assert kept == {k for k, v in got.items() if v[1] == k}


def test_jaccard_empty(spark, nothing):
    assert jaccard_join.jaccard_classes(spark, nothing).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["label"] for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_exact_dedup_against_brute_force(spark, docs, nothing):
    groups = {}
    for r in corpus():
        groups.setdefault(r[1] or "", []).append(r[0])
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark, docs).collect()}
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {max(v) for v in groups.values()}
    assert {r[0] for r in exact_dedup.keep_one(spark, docs, most_broadcast=0).collect()} == {max(v) for v in groups.values()}
    assert exact_dedup.exact_dedup(spark, nothing).count() == 0


def test_directory_doubles_where_a_bucket_overflows(spark):
    counted = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(10).cast("long").alias("size"))
    levels = exact_dedup.directory(counted, 100, 8)
    got = exact_dedup.in_bucket(counted, levels)
    held = {r["bucket"]: r["n"] for r in got.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert max(held.values()) <= 100 and len(held) >= 40 and None not in held
    owners = {}
    for r in got.collect():
        lo, hi, n = owners.get(r["owner"], (1 << 64, 0, 0))
        owners[r["owner"]] = min(lo, r["h"] % (1 << 64)), max(hi, r["h"] % (1 << 64)), n + 1
    assert set(owners) == set(range(8)) and max(v[2] for v in owners.values()) < 800
    ranges = [owners[k][:2] for k in range(8)]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))  # each owner has a range of hashes of its own
    # all hashes within one slot: only that slot goes on splitting
    near = spark.range(4000).select((F.col("id") + 5).alias("h"), F.lit(10).cast("long").alias("size"))
    levels = exact_dedup.directory(near, 100, 8)
    held = exact_dedup.in_bucket(near, levels).groupBy("bucket").count().collect()
    assert len(levels) > 1 and max(r["count"] for r in held) <= 100 and sum(r["count"] for r in held) == 4000


@pytest.mark.parametrize("hash_of", [lambda body: F.lit(7), lambda body: F.length(body) % 3 - 1, lambda body: -F.length(body)], ids=["one", "three", "lengths"])
def test_exact_dedup_with_colliding_hashes(spark, docs, hash_of):
    want = sorted(map(tuple, exact_dedup.exact_dedup(spark, docs).collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(spark, docs, capacity=2, hash_of=hash_of).collect())) == want


def test_exact_dedup_deals_texts_to_owners(spark, docs):
    index, levels, total = exact_dedup.build_index(spark, docs)
    assert total == docs.count() and sum(r[0] for r in index.select("group_size").collect()) == total
    assert index.where("bucket IS NULL").count() == 0 and {r[0] for r in index.select("chain").collect()} == {1}


TIGHT = suffix_dedup.Tuning(cells=2000, strings=3000, unit=2000, hot=3, piece=300, chunk=700, name_bits=5)


@pytest.mark.parametrize("tuning", [suffix_dedup.Tuning(), TIGHT], ids=["plain", "tight"])
def test_suffix_dedup_against_brute_force(spark, docs, tuning):
    """tight: many units and blocks, hot triggers, texts in pieces, and names of 32 values only, which clash."""
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark, docs, tuning=tuning).collect()}
    seen = set()
    for i, t, *_ in corpus():
        b = (t or "").encode()
        grams = [b[k : k + 50] for k in range(len(b) - 49)]
        mask, spans = bytearray(len(b)), 0
        for k, g in enumerate(grams):
            if g in seen:
                mask[k : k + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(mask)))
        seen.update(grams)
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        assert got[i] == (len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_classes_are_exact_and_in_order():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = np.arange(0, 2950)
    code = suffix_dedup.suffix_classes(raw, starts, 50)
    strings = [raw[i : i + 50].tobytes() for i in starts]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    want = np.array([order[s] for s in strings])
    assert len(set(code)) == len(order) and (np.argsort(code, kind="stable") == np.argsort(want, kind="stable")).all()


def test_suffix_dedup_empty(spark, nothing):
    assert suffix_dedup.remove_repeats(spark, nothing).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            bad = kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_personal_data_against_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice(rng.choice(["0123456789", "ab@.-+ ()é", "1.2.", "@a.b", "+1 2-3"])) for _ in range(rng.randint(0, 60)))
        base, spans = pii.find_spans(t)
        assert base == base_spans(t) and set(base) <= set(spans)


def test_personal_data_added_kinds_and_rows(spark, docs, nothing):
    t = "Account: 1234-567890 and https://me:secret@host.example/x. IBAN GB82 WEST 1234 5698 7654 32"
    assert {s[2] for s in pii.find_spans(t)[1]} >= {"account", "url"}
    assert pii.find_spans("The account of the year 1999 was good.")[1] == []
    got = pii.find_personal_data(docs)
    assert got.count() == docs.count() and got.where("doc_id = 120").first()["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(nothing).count() == 0


def test_packing_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in corpus()}
    got = packing.pack_documents(spark, docs, window=256).collect()
    pieces = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, p in pieces.items():
        assert [s for s, _ in sorted(p)] == list(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1]) and sum(n for _, n in p) == len(ids[i])
    assert pieces.keys() == ids.keys()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(used) == set(range(len(used)))
    for p in used.values():
        assert [o for o, _ in sorted(p)] == list(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1]) and sum(n for _, n in p) <= 256
    assert len(used) <= 1.05 * sum(map(len, ids.values())) / 256 + 1
    assert packing.pack_documents(spark, nothing).count() == 0


def test_packing_plan_uses_up_the_histogram():
    rng = np.random.default_rng(5)
    counts = np.zeros(65, np.int64)
    counts[1:] = rng.integers(0, 2000, 64) // np.arange(1, 65) * (rng.random(64) < 0.8)
    plan, loose = packing.pack_plan(counts, 64)
    used = Counter(dict(loose))
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 64
        for v in lengths:
            used[v] += n
    assert used == Counter({k: int(c) for k, c in enumerate(counts) if c})
    assert sum(n for _, n in plan) + -(-sum(v * n for v, n in loose) // 64) <= 1.02 * (counts * np.arange(65)).sum() / 64 + 1
    assert packing.pack_plan(np.zeros(65, np.int64), 64) == ([], [])


@pytest.mark.parametrize("held", [{1100: 1000}, {1100: 1000, 200: 4000}, {1000: 1, 100: 10}, {1500: 700, 1400: 5, 3: 2}, {2048: 9, 1: 3000}])
def test_packing_pads_little(held):
    counts = np.zeros(2049, np.int64)
    for v, n in held.items():
        counts[v] = n
    plan, loose = packing.pack_plan(counts, 2048)
    total = sum(v * n for v, n in held.items())
    assert sum(n for _, n in plan) + -(-sum(v * n for v, n in loose) // 2048) <= 1.01 * total / 2048 + 1


def test_packing_greedy_fills_the_fullest():
    counts = np.zeros(2049, np.int64)
    counts[1000], counts[100] = 1, 10
    assert packing.greedy(counts, 2048) == {48: [((1000, *[100] * 10), 1)]}
    counts = np.zeros(2049, np.int64)
    counts[1100], counts[200] = 1000, 4000
    assert packing.greedy(counts, 2048) == {148: [((1100, 200, 200, 200, 200), 1000)]}


def test_packing_of_rests_that_must_be_cut(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = [(k, "word " * (139 + k % 3)) for k in range(200)] + [(None, "a b"), (7, "word " * 139), (500, "x y " * 9000 + "z" * 70)]
    got = packing.pack_documents(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(4), window=256).collect()
    assert sum(r["length"] for r in got) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] not in (7, None):
            ids = [*tok.encode(dict(texts)[r["doc_id"]], add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    for p in used.values():
        assert [o for o, _ in sorted(p)] == list(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1]) and sum(n for _, n in p) <= 256
    assert set(used) == set(range(len(used))) and len(used) <= 1.01 * sum(r["length"] for r in got) / 256 + 1


def test_long_texts_are_tokenised_in_parts():
    from tokenizers import Tokenizer

    import pyarrow as pa

    text = "Some words, and " * 400 + "q" * 900 + " \nend. " * 300
    run = packing._cut(packing.tokenizer_path(), 100, 1, chunk=500)
    rows = pa.Table.from_batches(run([pa.RecordBatch.from_arrays([pa.array([4], pa.int64()), pa.array([text]), pa.array([0], pa.int64())], ["doc_id", "body", "h"])])).to_pylist()
    ids = [*Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids, 1]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in rows] == [(k, min(100, len(ids) - k), len(ids)) for k in range(0, len(ids), 100)]
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rows)


def test_token_parts_are_the_tokenizers_own():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["", "  a  b\n\n", "It's. don't... \"x\". <|startoftext|>. É.é, É. ﬁx K. İstanbul. 12,3. ½. a\tb\x0bc. x|y| ***.", "日本語。テスト! ß. ẞ."]
    ids, off = packing.token_runs(pa.array(texts), packing.tokenizer_path())
    tok = Tokenizer.from_file(packing.tokenizer_path())
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    rng = random.Random(11)
    odd = ["\u0130", "\u0307", "J\u030c", "\u0958", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "\u03a3", "\u1e9e", "\u2126", "\u00c9", "\u00f1", "\u00aa", "\u00df", "'S", "'ll", "\u2019", ".", ",", "!", "|", "$", " ", "\n", "\t", "\xa0", "A", "z", "I", "7", "\u0660", "\u4e00", "e\u0301", "\ufb01"]
    texts = ["T\u00dcRK\u0130YE CUMHUR\u0130YET\u0130, ANKARA", *("".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(4000))]
    ids, off = packing.token_runs(pa.array(texts), packing.tokenizer_path())
    for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
        assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_mixing_targets_and_totals(spark, docs, nothing):
    got = mixing.mix_sources(spark, docs, block=16).collect()
    assert len(got) == len(corpus())
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    by = {r[0]: r[3] for r in corpus()}
    total = Counter()
    for i, n in size.items():
        total[by[i]] += n
    names = sorted([s for s in total if s is not None]) + [None]
    goal = dict(zip(names, mixing.targets([total[s] for s in names]), strict=True))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[by[r["doc_id"]]] and r["target"] == pytest.approx(goal[by[r["doc_id"]]])
        assert r["taken"] <= 3 * r["size"]
        taken[by[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    again = mixing.mix_sources(spark, docs.repartition(3), block=16).select("doc_id", "target").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["target"]) for r in got)
    rows = Counter()
    for r in mixing.mixed_documents(spark, docs, block=16).collect():
        rows[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == dict(rows)
    assert mixing.mix_sources(spark, nothing).count() == 0 and mixing.mixed_documents(spark, nothing).count() == 0


@pytest.mark.parametrize("most_sources", [100_000, 0], ids=["driver", "executors"])
def test_mixing_against_a_replay_of_the_slots(spark, docs, most_sources):
    """Word by word: the streams are laid out in plain Python, and each slot's block is walked."""
    block, size = 16, {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    salt = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(mixing.SALTS))).collect()}
    by = {}
    for r in corpus():
        by.setdefault(r[3], []).append(r[0])
    names = sorted([s for s in by if s is not None]) + [None]
    sizes = [sum(size[i] for i in by[s]) for s in names]
    taken = Counter()
    for k, (name, goal) in enumerate(zip(names, mixing.targets(sizes), strict=True)):
        stream = [i for i in sorted(by[name], key=lambda i: (salt[i], i)) for _ in range(size[i])]
        blocks = -(-len(stream) // block)
        slots, last = mixing.slots_for(round(goal), len(stream), k, block)
        for slot in range(slots):
            at = int(mixing.feistel(np.array([slot % blocks]), blocks, mixing.slot_key([k], [slot // blocks]))[0])
            taken.update(stream[at * block : (at + 1) * block][: last if slot == slots - 1 else block])
    got = mixing.mix_sources(spark, docs, block=block, most_sources=most_sources).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {i: taken[i] for i in size}
    filled = {}
    for r in got:
        places = [tuple(map(int, p.split(":"))) for p in r["places"].split(",") if p]
        assert sum(hi - lo for *_, lo, hi in places) == r["taken"]
        for shard, slot, lo, hi in places:
            filled.setdefault((by_of(by, r["doc_id"]), slot), []).append((shard, hi - lo))
    assert all(len({shard for shard, _ in v}) == 1 and sum(n for _, n in v) <= block for v in filled.values())
    per = Counter(v[0][0] for v in filled.values())
    assert max(per.values()) - min(per.values()) <= 1 or most_sources == 0 and max(per.values()) <= -(-len(filled) // mixing.SHARDS)


def by_of(by, i):
    return next(s for s, ids in by.items() if i in ids)


def test_mixing_of_many_sources_is_planned_alike(spark):
    rng = random.Random(7)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice([None, *(f"s{j:03}" for j in range(150))])) for k in range(600)] + [(9, "w w", "s001"), (9, "v v", "s001"), (None, "u", "s002")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sets = [sorted(map(tuple, mixing.mix_sources(spark, d, block=8, most_sources=n).drop("places").fillna(-1).collect())) for d, n in ((df, 1000), (df, 10), (df.repartition(7), 1000))]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == len(rows)
    texts = [sorted(str(tuple(r)) for r in mixing.mixed_documents(spark, d, block=8).collect()) for d in (df, df.repartition(7))]
    assert texts[0] == texts[1]


def test_stages_take_any_column_names(spark, tmp_path):
    """Columns called like the operators' own, repeated ids, null ids and null texts."""
    names = ["__sha", "__row", "__run", "__runs", "__n_words", "n_words", "row", "doc", "body", "h", "sha", "bucket", "owner", "keep_id", "group_size", "tie", "n", "fp", "rep", "id", "label", "__own", "score"]
    rows = [(i, t, "s", 3, *[k] * len(names)) for k, (i, t) in enumerate([(1, "a b c"), (2, "a b c"), (2, "d e f g"), (None, "d e f g"), (None, None), (5, ""), (6, "a b c d e f g"), (6, "a b c d e f g")])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = lambda df: sorted(map(str, df.select("doc_id", "text", *[F.col(f"`{n}`") for n in names]).collect()))
    every = own(d)
    for step in (lambda: quality.keep_good(spark, d, str(tmp_path)), lambda: exact_dedup.keep_one(spark, d), lambda: exact_dedup.keep_one(spark, d, most_broadcast=0), lambda: jaccard_join.keep_one(spark, d), lambda: mixing.mixed_documents(spark, d)):
        out = step()
        assert out.columns == d.columns and set(own(out)) <= set(every)
    # of the equal texts the largest id stays, twice where the same record repeats
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.keep_one(spark, d).where("doc_id IS NOT NULL").collect()) == [(2, "a b c"), (2, "d e f g"), (5, ""), (6, "a b c d e f g"), (6, "a b c d e f g")]
    for f in (lambda: jaccard_join.jaccard_classes(spark, d), lambda: mixing.mix_sources(spark, d), lambda: pii.find_personal_data(d), lambda: exact_dedup.exact_dedup(spark, d), lambda: suffix_dedup.remove_repeats(spark, d), lambda: licenses.scan_licences(d), lambda: packing.pack_documents(spark, d)):
        f().collect()


def test_mixing_pieces():
    assert mixing.targets([100, 10, 10]) == pytest.approx([75, 30, 15])
    assert mixing.targets([1000, 1, 1]) == pytest.approx([996, 3, 3]) and mixing.targets([0, 5]) == pytest.approx([0, 5])
    for n in (1, 2, 3, 7, 100, 1025):
        p = mixing.feistel(np.arange(n), n, mixing.slot_key([3], [1]))
        assert sorted(p) == list(range(n)) and (mixing.feistel(p, n, mixing.slot_key([3], [1]), back=True) == np.arange(n)).all()
    c = mixing.shard_counts([100, 7, 0], 8)
    assert c.sum(0).tolist() == [100, 7, 0] and c.min() >= 0 and c.sum(1).max() - c.sum(1).min() <= 1


def test_lexicon_keeps_insults_of_few_rows(spark):
    rows = [(f"you are a grobian number {'abcdefgh'[k % 8]}", 1.0) for k in range(981)] + [("what a zwockel again", 1.0)] * 19 + [("a quiet walk by the river", 0.0)] * 1000
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y double").unionAll(spark.createDataFrame(rows[:981], "text string, y double")))
    assert "zwockel" in words or any("zwockel".startswith(s) for s in stems)
    assert toxicity.Grammar(words, stems).insult("zwockel") > 0 == toxicity.Grammar(words, stems).insult("river")


def test_account_numbers_later_in_the_sentence():
    found = lambda t: [t[a:b] for a, b, kind in pii.find_spans(t)[1] if kind == "account"]
    for t, want in [
        ("Account Number: 12345678", "12345678"),
        ("passport No. X1234567 was lost", "X1234567"),
        ("the account number ending in 123456 is closed", "123456"),
        ("Acct. no. 123456-78", "123456-78"),
        ("IBAN of the seller, as it was given to us: DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 00"),
        ("IBAN DE 89370400440532013000", "DE 89370400440532013000"),
    ]:
        assert found(t) == [want]
    for t in ("My account. 12345678 people", "account\n12345678", "Account of 2019 with 12345678", "IBAN code DE88 3704 0044 0532 0130 00", "account No", "account " * 50_000):
        assert found(t) == []


def test_licences_against_plain_reading(spark, nothing):
    grant = ["; ".join(licenses.SENTENCES[k][0] for k in rule) for _, rule in licenses.RULES]
    rows = [(k, f"Intro text here.\n{t}.\nMore words.") for k, t in enumerate(grant)] + [(90, None), (91, ""), (92, "A licence is nice. MIT licensed people."), (93, "x " * 50000 + "\nReleased under the MIT License.\n")]
    got = {r["doc_id"]: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, rule) in enumerate(licenses.RULES):
        assert name in got[k]["licences"].split(",") and got[k]["n_sentences"] == len(rule)
    assert [got[k]["licence"] for k in (90, 91, 92, 93)] == [None, None, None, "MIT"]
    assert not [s for v in licenses.SENTENCES.values() for s in v if re.search(r"[.!?;:]\s", s)]
    assert all(re.search(licenses.CUE, s) for v in licenses.SENTENCES.values() for s in v)
    assert licenses.scan_licences(nothing).count() == 0


def test_licences_in_wrapped_texts(spark):
    import textwrap

    known = lambda *ids: [licenses.SENTENCES[k][0] for k in ids]
    mit = [known("mit-name")[0], "Copyright (c) 2020 A. Person", known("mit-grant")[0] + ":", known("mit-notice")[0] + ".", known("as-is")[0] + ". IN NO EVENT SHALL THE AUTHORS BE LIABLE."]
    bsd = ["Copyright (c) 2020, A. Person", known("bsd-grant")[0] + ":", *[f"{k}. {s}." for k, s in enumerate(known("bsd-source", "bsd-binary", "bsd-names"), 1)]]
    gpl = ["; ".join(["This program is free software", *licenses.SENTENCES["gpl2-later"]]) + "."]
    wrap = lambda paragraphs, mark, gap: f"\n{mark}{gap}".join(f"\n{mark}".join(textwrap.wrap(p, 70)) for p in paragraphs)
    rows, want = [], {}
    for mark in ("", "# ", "// ", " * ", "dnl ", "REM "):
        for gap in ("", f"\n{mark}", f"\r\n{mark}"):
            for paragraphs, name, n in ((mit, "MIT", 4), (bsd, "BSD-3-Clause", 4), (gpl, "GPL-2.0", 3)):
                want[len(rows)] = (name, n)
                rows.append((len(rows), f"{mark}{wrap(paragraphs, mark, gap)}\n"))
    rows += [(900, "Released under the\n\nMIT License"), (901, "Released under the. MIT Licenses"), (902, "Released under the\nMIT License\nand more"), (903, "Title\nMIT License\nof a kind")]
    got = {r["doc_id"]: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (got[k]["licence"], got[k]["n_sentences"]) for k in want} == want
    assert [got[k]["sentence_ids"] for k in (900, 901, 902, 903)] == ["mit-name", "", "mit-ref", "mit-name"]


def test_licences_of_other_texts(spark):
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    library = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"
    zlib_text = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"
    bsd = "; ".join(licenses.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    texts = [header, library, apache, zlib_text, bsd, "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", f"{apache}\n\n{bsd}", "# Distributed under the Boost Software License, Version 1.0.\n# (See accompanying file)", None, ""]
    got = {r["doc_id"]: r["licences"] for r in licenses.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == ["AGPL-3.0", "LGPL-2.1", "Apache-2.0", "Zlib", "BSD-3-Clause", "GPL-3.0", "Apache-2.0,BSD-3-Clause", "BSL-1.0", "", ""]


def test_licences_against_the_sql_on_wrapped_texts(spark):
    import textwrap

    import duckdb
    import pandas as pd

    rng = random.Random(9)
    every, rows = [s for v in licenses.SENTENCES.values() for s in v], []
    for k in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice([rng.choice(every), rng.choice(every), "Some words of licence text", "copyright", ""])
            if rng.random() < 0.3:
                s = rng.choice(["rem ", "More on "]) + s
            if rng.random() < 0.6:
                mark = rng.choice(["", "# ", " * ", "REM ", "dnl "])
                s = mark + f"\n{mark}".join(textwrap.wrap(s, rng.choice([20, 40, 70])))
            parts.append(s)
        text = "".join(s + rng.choice(["\n", "\n\n", ". ", ".\n", "; ", " ", ":\r\n", "\nREM\nREM ", "\n#\n", " | "]) for s in parts)
        rows.append((k, text if k % 3 else text.upper()))
    rows += [(300, None), (301, "")]
    spark_rows = sorted(map(tuple, licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert spark_rows == sorted(con.execute(licenses.ORACLE).fetchall())
    assert len({r[3] for r in spark_rows}) > 20


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    x[10] = x[0]
    rows = [(k, v, "c") for k, v in enumerate(x)] + [(400, None, ""), (450, [0.0] * 8, ""), (500, [float("nan"), *[1.0] * 7], ""), (501, [None, *[1.0] * 7], "")] + [(600 + k, [1.0] * 8, "") for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    good = {k: np.array(v, float) for k, v, _ in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    found = vptree.nearest(spark, df, factor=1.0).collect()
    for q in [k for k in good if k % 50 == 0]:
        s = sorted((-round(float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q]))), 12), k) for k, v in good.items() if k != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [k for _, k, _ in mine] == [k for _, k in s] and [m[2] for m in mine] == pytest.approx([-a for a, _ in s], abs=1e-12)
    assert len(found) == 5 * sum(k % 50 == 0 for k in good)
    assert vptree.nearest(spark, df.limit(0)).count() == 0


def test_pruning_is_exact_at_factor_one_and_saves_work():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 6))
    x = vptree._unit((centres[rng.integers(0, 30, 6000)] + 0.05 * rng.normal(size=(6000, 6))))
    tree = vptree.VPTree(x, leaf=64)
    w = tree.search(x[:50], 5, 1.0)
    full = np.argsort(np.linalg.norm(x[:50, None] - x[None], axis=2), 1)[:, :5]
    assert all(set(a) == set(b) for a, b in zip(w, full, strict=True)) and tree.visited < 0.5 * 50 * 6000
    visited = tree.visited
    w = tree.search(x[:50], 5, 3.0)
    assert tree.visited <= visited and np.mean([len({*a} & {*b}) / 5 for a, b in zip(w, full, strict=True)]) >= 0.9


def brute_nearest(rows, k=5):
    """Ties, to 12 decimals, go to the smaller id."""
    out = {}
    for q, a in rows:
        if q % 50 == 0:
            s = [(-round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 12), i) for i, b in rows if i != q]
            out[q] = [i for _, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("kind", ["multiples", "signs"])
def test_ties_go_to_the_smaller_id(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "multiples":  # 400 multiples of one vector
        base = rng.normal(size=7)
        rows = [(k, (base * (0.3 + 0.37 * k)).tolist()) for k in range(400)]
    else:  # few distinct cosines
        rows = [(k, v.tolist()) for k, v in enumerate(rng.choice([-1.0, 1.0, 3.0], size=(500, 5)))]
    found = vptree.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=40)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute_nearest(rows)


def test_recall_of_a_relaxed_factor(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {tuple(r) for r in vptree.nearest(spark, df).select("query_id", "vec_id").collect()}
    assert exact == {(q, i) for q, v in brute_nearest(rows).items() for i in v}
    relaxed = {tuple(r) for r in vptree.nearest(spark, df, factor=1.5).select("query_id", "vec_id").collect()}
    assert len(exact & relaxed) >= 0.9 * len(exact)


def labelled(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["zqidiot", "zqmoron"])
        rows.append((k, " ".join(w), "en", "s", 0, "", "", "", ""))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(n, None, "en", "s", 0, "", "", "", ""), (n + 1, "", "en", "s", 0, "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark, nothing):
    docs, labels, truth = labelled(spark)
    for f, k, m, r in ((quality.score_quality, 1, 3, 1), (toxicity.score_toxicity, 2, 5, 0)):
        got = {x["doc_id"]: x for x in f(docs, labels).collect()}
        assert len(got) == len(truth) + 2 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
        assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % m == r) for i, x in got.items())
        held = [t for t in truth if got[t[0]]["held_out"]]
        assert np.mean([got[t[0]]["predicted"] == t[k] for t in held]) > 0.95
        assert f(docs, labels.limit(0)).count() == len(truth) + 2
        assert f(nothing, labels).count() == 0


def test_compiled_rules_are_the_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    b, rules = quality.fit_rules(x, y)
    direct = 1 / (1 + np.exp(-(b + sum(w * quality.holds(r, x) for w, r in rules))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    got = [r[0] for r in df.select(quality.compile_rules(b, rules)).collect()]
    assert np.allclose(sorted(got), sorted(direct)) and ((direct > 0.5) == (y > 0)).mean() > 0.97


def test_clause_patterns():
    g = toxicity.Grammar({"fool": 2.0}, {"zqab": 3.0})
    kinds = lambda t: [x[2] for x in g.clauses(t)]
    assert kinds("A fool. Nothing here. You fool!") == [{"plain": 2.0}, {"targeted": 2.0}]
    assert kinds("Not a fool; he said fool") == [{"negated": 2.0}, {"reported": 2.0}]
    assert kinds("I will kill you. They said they would kill you. foolish zqab zqabel") == [{"threat": 1.0}, {"plain": 3.0}]
    assert kinds("I will kill you fool. fool but not a fool") == [{"targeted": 2.0, "threat": 1.0}, {"plain": 2.0, "negated": 2.0}]
    assert kinds("kill the mosquito du matin; je vais te tuer; tuer him; Don\u2019t kill you; l'fool") == [{"threat": 1.0}, {"plain": 2.0}]
    assert kinds("") == [] and g.describe(None)[-1] == 0.0


def test_composed_machine_is_the_cascade():
    rng = random.Random(3)
    symbols = [("word",), ("insult",), ("negation",), ("report",), ("target", ("en",)), ("threat", ("en", "fr")), ("target", ("de", "fr"))]
    none = frozenset()
    for _ in range(300):
        line = [(rng.choice(symbols), rng.random()) for _ in range(rng.randint(0, 12))]
        state, out = toxicity.machine().run(line)
        step, states = line, []
        for t in (toxicity.Transducer(0, toxicity._negation), toxicity.Transducer(False, toxicity._reported), toxicity.Transducer(none, toxicity._remember("target")), toxicity.Transducer(none, toxicity._remember("threat"))):
            last, step = t.run(step)
            states.append(last)
        assert out == step and state == (((states[0], states[1]), states[2]), states[3])


def plain_toxicity(text, words, stems, w):
    """Clause by clause and word by word, without machines or anchors."""
    total = dict.fromkeys(toxicity.PATTERNS, 0.0)
    anchors = {*" ".join(toxicity.THREATS.values()).split()}
    for part in re.split(r"[.!?;:\n|]", (text or "").lower().replace("\u2019", "'")):
        found = [x[x.find("'") + 1 :] if 0 < x.find("'") <= 2 and x not in toxicity.NEGATIONS else x for x in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", part)]
        weight = lambda x: max([words.get(x, 0.0), *(stems.get(x[:n], 0.0) for n in toxicity.STEMS if len(x) > n)])  # noqa: E731, B023
        langs = {k for x in found if not weight(x) and x not in toxicity.NEGATIONS and x not in toxicity.REPORTS for k, v in toxicity.TARGETS.items() if x in v.split()}
        since, reported, hit = 99, False, {}
        for x in found:
            since += 1
            if weight(x):
                kind = "negated" if since <= 2 else "reported" if reported else "targeted" if langs else "plain"
                hit[kind] = hit.get(kind, 0.0) + weight(x)
            elif x in toxicity.REPORTS:
                reported = True
            elif x in toxicity.NEGATIONS:
                since = 0
            elif x in anchors and since > 2 and not reported and any(x in toxicity.THREATS[k].split() for k in langs):
                hit["threat"] = hit.get("threat", 0.0) + 1
        for k, v in hit.items():
            total[k] += v
    x = [np.log1p(total[p]) for p in toxicity.PATTERNS] + [float(any(total.values())), 1.0]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, w), -30, 30)))


def test_toxicity_against_a_plain_rescoring(spark):
    from conftest import SF

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    grammar, w = toxicity.fit_toxicity(docs, labels)
    rng = random.Random(6)
    words = [*list(grammar.words)[:5], "kill", "tuer", "not", "said", "you", "du", "te", "l'idee", "calm", "Don\u2019t", "her", "."]
    extra = [(10**6 + k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for k in range(200)] + [(2 * 10**6, None), (2 * 10**6, "")]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    got = toxicity.score_toxicity(rows, labels).select("doc_id", "score").collect()
    want = sorted((r["doc_id"], plain_toxicity(r["text"], grammar.words, grammar.stems, w)) for r in rows.collect())
    assert [i for i, _ in want] == sorted(r["doc_id"] for r in got)
    assert np.allclose([v for _, v in want], [s for _, s in sorted((r["doc_id"], r["score"]) for r in got)])


def plain_stats(text):
    raw = (text or "").encode()
    words = [lower(x) for x in WORD.findall(text or "")]
    share = lambda chars: sum(c in chars for c in raw) / max(1, len(raw))
    n, odd = max(1, len(words)), b"*$%#&^~@<>{}[]\\=_+!"
    run = longest = 0
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 0
        longest = max(longest, run)
    return {
        "n_words": np.log1p(len(words)), "word_bytes": sum(c not in b" \t\r\n\x0b\x0c" for c in raw) / n, "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digit": share(b"0123456789"), "stop": share(b".?;:"), "comma": share(b","), "bang": share(b"!"), "bar": share(b"|"), "symbol": share(odd[:-1]),
        "newline": share(b"\n"), "space": share(b" \t\r\n\x0b\x0c"), "high": sum(c >= 128 for c in raw) / max(1, len(raw)),
        "symbol_runs": sum(a == b and a in odd for a, b in zip(raw, raw[1:], strict=False)) / n, "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "distinct": len(set(words)) / n, "second_repeats": sum(a == b for a, b in zip(words, words[2:], strict=False)) / n,
        "upper_words": sum(65 <= a <= 90 and 65 <= b <= 90 for a, b in zip(raw, raw[1:], strict=False)) / n, "top_run": np.log1p(longest),
    }


def test_quality_against_a_plain_rescoring(spark):
    from conftest import SF

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    b, rules = quality.fit_quality(docs, labels)
    extra = [(10**6 + k, t) for k, t in enumerate([None, "", "!!! $$ AB", "!!", "ABC", "CD ab ab ab AB\n", "é!", "!é", " \t"])]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string").coalesce(1))
    want = {}
    for r in rows.collect():
        x = plain_stats(r["text"])
        f = b + sum(v for v, rule in rules if all((x[quality.STATS[k]] > edge) == above for k, edge, above in rule))
        want[r["doc_id"]] = 1 / (1 + np.exp(-f))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(rows, labels).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled(spark, 300)
    copies = docs.limit(40).withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(copies).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, d, str(tmp_path)).cache()
    score = {r["doc_id"]: r["predicted"] for r in quality.score_quality(d, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    assert good.columns == d.columns and sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, p in score.items() if p)
    groups = {}
    for r in good.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    unique = stages["exact_dedup"](spark, good, str(tmp_path)).cache()
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(max(v) for v in groups.values())
    apart = stages["ngram_jaccard"](spark, unique, str(tmp_path)).cache()
    brute = jaccard_brute([(r["doc_id"], r["text"]) for r in unique.collect()])
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, v in brute.items() if v[1] == i)
    mixed = stages["mixing"](spark, apart, str(tmp_path)).cache()
    words = sum(len(WORD.findall(r["text"] or "")) for r in apart.collect())
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == words  # one source: all of it, once
    packed = stages["packing"](spark, mixed, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] == corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0]


def test_native_plans_have_no_python(spark, docs):
    for df in (exact_dedup.exact_dedup(spark, docs), licenses.scan_licences(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
