"""Packing token sequences: shallow length combinations, counted by non-negative least squares.

Documents are tokenised where they lie and cut into windows of `window` ids; what is left of each is one shorter piece. Only the pieces'
lengths matter from there on. Their histogram has at most `window` bins, so it fits on the driver whatever the input. There, combinations
of two to four lengths that fill a window exactly are enumerated, non-negative least squares finds how often to repeat each so that the
histogram is used up, the repeats are rounded down to what is there, and the residual lengths are packed greedily (largest first, as many
as fit into the fullest sequence that holds one). Sequences that this leaves with over 1 % padding are taken apart: their pieces are laid
end to end and cut again where a sequence is full. The plan says which ranks of which length go where; each piece looks up its own rank.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, documents, stage, tidy

WINDOW, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
CACHED_WORDS = 600_000  # words whose ids a worker remembers, about 200 bytes each
CHUNK = 2 << 20
RANKS_PER_TASK, MOST_RANKED = 2_000, 100_000  # pieces of one length ranked at once, more where that makes over MOST_RANKED parts
SLACK = 100  # a sequence may keep one window/SLACK of padding
_CACHES: dict[str, tuple] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    """(the tokenizer, ids of words met before): words between blanks are tokenised alike wherever they stand."""
    if path not in _CACHES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _CACHES[path] = Tokenizer.from_file(path), {}
    return _CACHES[path]


def _known_ids(names: list[str], path: str, cached: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words one after another, number of ids of each)."""
    tok, known = _encoder(path)
    if len(known) > cached:
        known.clear()
    new = [w for w in names if w not in known]
    for a in range(0, len(new), 5000):
        part = new[a : a + 5000]
        for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
    parts = [known[w] for w in names]
    return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


# Marks that may stand at a word's end, and what they may follow (letters that no normalising joins with them).
_MARKS = ".,;:!?$%&*#|"
_STEM_END = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"


def token_runs(column, path: str, cached: int = CACHED_WORDS):
    """(ids of all rows, offsets of the rows) of an Arrow string column without nulls.

    Rows are parted at blanks, which the tokenizer drops, and words from the marks at their end, where the tokenizer parts them anyway: after
    an ASCII or Latin-1 letter or digit only, as others may be normalised to something that ends in a mark of its own. Words of ASCII
    letters are put in lower case, as the tokenizer has them, but for those that may hold a special token, which it finds before. Each
    distinct part goes through the tokenizer once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(pc.replace_substring(column.cast(pa.large_string()), "\n", " "), " ")
    words = lists.flatten().dictionary_encode()
    index, dictionary = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    stems = pc.utf8_rtrim(dictionary, characters=_MARKS)
    stems = pc.if_else(pc.match_substring_regex(stems, _STEM_END), stems, dictionary)
    plain = pc.and_not(pc.string_is_ascii(stems), pc.match_substring(stems, "<|"))
    parts = pa.concat_arrays([pc.if_else(plain, pc.ascii_lower(stems), stems), _tails(dictionary, stems)]).dictionary_encode()
    flat, size = _known_ids(parts.dictionary.to_pylist(), path, cached)
    begin = np.cumsum(size) - size
    both = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
    order = both[:, index].T.ravel()  # stem, tail, stem, tail...
    take = size[order]
    ends = np.cumsum(take)
    where = np.repeat(begin[order] - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)
    per_row = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    return flat[where], np.r_[0, ends][2 * per_row]


def _tails(words, stems):
    """What each word has after its stem."""
    import pyarrow as pa
    import pyarrow.compute as pc

    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    left = pc.binary_length(stems).to_numpy(zero_copy_only=False)
    size = np.diff(off) - left
    at = np.repeat(off[:-1] + left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    body = pa.py_buffer(raw[at].tobytes())
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64).tobytes()), body)


def _pieces(text: str, most: int):
    """The text cut at blanks into parts of about `most` letters; tokens never cross a blank."""
    a = 0
    while len(text) - a > most:
        b = max(text.rfind(" ", a, a + most), text.rfind("\n", a, a + most))
        if b <= a:
            later = [x for x in (text.find(" ", a + most), text.find("\n", a + most)) if x >= 0]
            if not later:
                break
            b = min(later)
        yield text[a:b]
        a = b
    yield text[a:]


def _whole(text: str, path: str, end_id: int, chunk: int, cached: int):
    """Arrays of the ids of one text, part by part, and the end id."""
    import pyarrow as pa

    for part in _pieces(text, chunk):
        yield token_runs(pa.array([part]), path, cached)[0]
    yield np.array([end_id], np.uint32)


def _cut(path: str, window: int, end_id: int, chunk: int = CHUNK, cached: int = CACHED_WORDS):
    """Rows doc_id, start, length, ids_crc32, doc_tokens, h: the windows of each text and its rest."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def windows(name, h, arrays):
        rows, rest, at = [], np.zeros(0, np.uint32), 0
        for ids in arrays:
            rest = np.concatenate([rest, ids]) if len(rest) else ids
            n = len(rest) // window
            for s in range(0, n * window, window):
                rows.append((name, at + s, window, zlib.crc32(rest[s : s + window].astype("<u4").tobytes())))
            rest, at = rest[n * window :], at + n * window
        if len(rest):
            rows.append((name, at, len(rest), zlib.crc32(rest.astype("<u4").tobytes())))
        return [(*r, at + len(rest), h) for r in rows]

    def run(batches):
        for b in batches:
            ids, hashes, body = b.column("doc_id").to_pylist(), b.column("h").to_pylist(), b.column("body").fill_null("")
            width = np.cumsum(pc.binary_length(body).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(body):
                before = int(width[a - 1]) if a else 0
                k = max(a + 1, int(np.searchsorted(width, before + chunk)))
                if k == a + 1 and width[a] - before > 2 * chunk:
                    rows = windows(ids[a], hashes[a], _whole(body[a].as_py(), path, end_id, chunk, cached))
                else:
                    flat, off = token_runs(body.slice(a, k - a), path, cached)
                    raw = memoryview(np.insert(flat, off[1:], end_id).astype("<u4").tobytes())
                    rows, ends = [], (off + np.arange(len(off))).tolist()
                    for name, h, lo, hi in zip(ids[a:k], hashes[a:k], ends[:-1], ends[1:], strict=True):
                        for s in range(lo, hi, window):
                            part = raw[4 * s : 4 * min(hi, s + window)]
                            rows.append((name, s - lo, len(part) // 4, zlib.crc32(part), hi - lo, h))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "h"])
                a = k

    return run


# ---- the plan, over a histogram of at most `window` bins ---------------------------------------------------------------------


def combinations(counts: np.ndarray, window: int, common: tuple[int, int] = (96, 20)) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths in use that fill the window: itself, all pairs, triples and fours led by the most common lengths."""
    have = counts > 0
    out = {(window,)} if have[window] else set()
    out |= {(window - a, a) for a in range(1, window // 2 + 1) if have[a] and have[window - a]}
    order = [int(k) for k in np.argsort(-counts[1:window], kind="stable") + 1 if counts[k] > 0]
    threes, fours = order[: common[0]], order[: common[1]]
    for i, a in enumerate(threes):
        for b in threes[i:]:
            c = window - a - b
            if c > 0 and have[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    for i, a in enumerate(fours):
        for j, b in enumerate(fours[i:]):
            for c in fours[i + j :]:
                d = window - a - b - c
                if d > 0 and have[d]:
                    out.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(out, key=lambda x: (len(x), [-v for v in x]))


def nnls_counts(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """min |sum_j x_j A_j - counts|, x >= 0, by coordinate descent; A_j counts the lengths of combination j."""
    cols = []
    for c in combos:
        at, times = np.unique(c, return_counts=True)
        cols.append((at.tolist(), times.tolist(), float((times**2).sum())))
    rest = counts.astype(float).tolist()
    x = [0.0] * len(cols)
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, times, norm) in enumerate(cols):
            step = sum(t * rest[k] for k, t in zip(at, times, strict=True)) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, t in zip(at, times, strict=True):
                    rest[k] -= t * step
        if moved < 0.25:
            break
    return np.array(x)


def pack_plan(counts: np.ndarray, window: int) -> tuple[list[tuple[tuple[int, ...], int]], list[tuple[int, int]]]:
    """([(lengths of a sequence, repeats)], [(length, pieces)] to be laid end to end), which together use up counts[0..window] exactly."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(left, window)
    for combo, x in zip(combos, nnls_counts(combos, left), strict=True):
        at, times = np.unique(combo, return_counts=True)
        n = int(min(np.floor(x + 1e-9), (left[at] // times).min())) if len(combo) > 1 else int(left[window])
        if n > 0:
            plan.append((combo, n))
            left[at] -= n * times
    for combo in combos:  # rounding down leaves exact fits
        at, times = np.unique(combo, return_counts=True)
        n = int((left[at] // times).min())
        if n > 0:
            plan.append((combo, n))
            left[at] -= n * times
    room = greedy(left, window)
    loose: dict[int, int] = defaultdict(int)
    for free, held in room.items():
        if free * SLACK <= window:
            plan += held
        else:
            for lengths, n in held:
                for v in lengths:
                    loose[v] += n
    return plan, sorted(loose.items(), reverse=True)


def greedy(left: np.ndarray, window: int) -> dict[int, list[tuple[tuple[int, ...], int]]]:
    """free space -> [(lengths, how many such sequences)]: largest first, as many as fit into the fullest sequences that hold one."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(window, 0, -1):
        need = int(left[length])
        for free in range(length, window):
            fit = free // length
            kept = []
            while need and room[free]:
                held, n = room[free].pop()
                full = min(n, need // fit)
                if full:
                    room[free - fit * length].append((held + (length,) * fit, full))
                    need -= full * fit
                    n -= full
                if n and 0 < need < fit:
                    room[free - need * length].append((held + (length,) * need, 1))
                    need, n = 0, n - 1
                if n:
                    kept.append((held, n))
            room[free] += kept
            if not need:
                break
        if need:
            fit = window // length
            whole, over = divmod(need, fit)
            if whole:
                room[window - fit * length].append(((length,) * fit, whole))
            if over:
                room[window - over * length].append(((length,) * over, 1))
    return {k: v for k, v in room.items() if v}


def plan_table(plan, loose) -> tuple[dict[int, np.ndarray], dict[int, tuple[int, int]], int]:
    """length -> rows (first rank, first sequence, offset), by first rank: piece number `rank` of its length goes to sequence
    first sequence + rank - first rank at that offset. length -> (first rank, place) of the pieces that are laid end to end after the
    last sequence, which comes third."""
    rows: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in plan:
        at = 0
        for v in lengths:
            rows[v].append((used[v], sequence, at))
            used[v] += n
            at += v
        sequence += n
    stream, at = {}, 0
    for v, n in loose:
        stream[v] = (used[v], at)
        at += v * n
    return {k: np.array(v, np.int64) for k, v in rows.items()}, stream, sequence


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, cached: int = CACHED_WORDS, chunk: int = CHUNK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. A text of any length is cut every `window` ids, a long one tokenised in parts. Rows that repeat
    are packed as often as they come; null ids stay null. cached (words whose ids a worker remembers) and chunk (bytes
    tokenised at once) steer memory only. Extra columns are not read. An empty table gives an empty result.
    """
    import pyarrow as pa

    path = path or tokenizer_path()
    cut = _cut(path, window, end_id, chunk, cached)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("body"), F.xxhash64("text").alias("h"))
    pieces = texts.mapInArrow(tidy(cut), ", ".join(f"{n} long" for n in [*names, "h"]))
    pieces = stage(spark, pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    plan, loose = pack_plan(counts, window)
    table, stream, first = plan_table(plan, loose)
    per_task = max(RANKS_PER_TASK, -(-int(counts.sum()) // MOST_RANKED))
    salts = F.array(*[F.lit(int(n)) for n in np.maximum(1, -(-counts // per_task))])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("piece"), F.get(salts, F.col("length").cast("int"))))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most window + MOST_RANKED rows are sent
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece")) - 1).join(F.broadcast(sums.select("length", "salt", "base")), ["length", "salt"])

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset, head = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for v in np.unique(length).tolist():
                m = np.flatnonzero(length == v)
                if v in stream:
                    end = rank[m] >= stream[v][0]
                    at = stream[v][1] + (rank[m[end]] - stream[v][0]) * v
                    sequence[m[end]], offset[m[end]] = first + at // window, at % window
                    head[m[end]] = np.where(at % window + v > window, window - at % window, 0)
                    m = m[~end]
                if len(m):
                    rows = table[v]
                    k = np.searchsorted(rows[:, 0], rank[m], "right") - 1
                    sequence[m], offset[m] = rows[k, 1] + rank[m] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in [*names, "h"]], *[pa.array(c) for c in (sequence, offset, head)]], [*names, "h", "sequence_id", "offset", "head"])

    out = [*names, "sequence_id", "offset"]
    placed = ranked.select(*names, "h", (F.col("rank") + F.col("base")).alias("rank")).mapInArrow(place, ", ".join(f"{n} long" for n in [*names, "h", "sequence_id", "offset", "head"]))
    if not stream:
        return placed.select(*out)

    def split(batches):
        """The texts of the rests that are cut again are tokenised once more, as only few are."""
        for b in batches:
            for k in range(len(b)):
                doc, start, length, crc, total, sequence, offset, head, body = (b.column(c)[k].as_py() for c in [*out, "head", "body"])
                ids = np.concatenate(list(_whole(body or "", path, end_id, chunk, cached)))[start : start + length].astype("<u4").tobytes()
                if zlib.crc32(ids) != crc:
                    raise RuntimeError(f"another text of document {doc}")
                rows = (doc, start, head, zlib.crc32(ids[: 4 * head]), total, sequence, offset), (doc, start + head, length - head, zlib.crc32(ids[4 * head :]), total, sequence + 1, 0)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], out)

    placed = stage(spark, placed, "placed")
    parted = placed.where("head > 0")
    few = sum(v * n for v, n in loose) // window <= BROADCAST_IDS  # each sequence cuts one piece at most
    asked = parted.select(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))
    texts = texts.join(F.broadcast(asked) if few else asked, same, "left_semi").dropDuplicates(["doc_id", "h"])
    parted = parted.join(texts.toDF("a_id", "body", "a_h"), same).select(*out, "head", "body")
    return placed.where("head = 0").select(*out).unionAll(parted.mapInArrow(tidy(split), ", ".join(f"{n} long" for n in out)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))
