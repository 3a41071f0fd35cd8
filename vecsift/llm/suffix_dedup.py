"""Removal of repeated passages by prefix-free parsing.

Positions are triggered by a rolling hash: each `width`-byte string belongs to the smallest hash of the `gram`-byte strings inside it, and
a run of strings that belong to one trigger is a phrase. Phrases overlap by width - 1 bytes, so every string lies whole in exactly one
phrase, and equal strings have equal triggers wherever they stand. The order of the corpus's suffixes, as far as width bytes tell them
apart, is therefore the order within the dictionary of distinct phrases, trigger by trigger, and what the order of the parse adds to it
is which documents a phrase stands in:

1. Parse: each text gives its triggers. A block of triggers finds those that two different texts have; what is parsed once is done.
2. Dictionary: tasks gather their texts in units of about `unit` bytes. A unit sends each distinct phrase of shared triggers once, with
   its smallest document, and keeps its parse (phrase, document, place) on the shared files.
3. A block of triggers sorts the suffixes of its dictionary by prefix doubling (8, 16, 32, then width bytes; exact, on the bytes; phrases
   of one name are compared byte by byte). Each class of equal width-byte prefixes gets the smallest document of its phrases. A unit is
   told, phrase by phrase, whether a smaller document outside has it whole and else which of its strings start in one.
4. Each unit combines the answers with its parse to spans of its documents, united; the bytes are cut out.

What a passage costs its block grows with the number of units that hold it, not of documents. Triggers with over `hot` phrases are parsed
further: each of their strings is a phrase of its own, dealt by its own hash, so a common trigger is spread over all blocks.
Copies of a whole text (equal SHA-256) take part once, under their smallest id; the others lose all bytes. Texts over a chunk are parsed
in overlapping pieces.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, chunks, documents, mix, skew_lookup, stage, tidy, tidy_cogroup, tidy_group
from .common import _powers as powers

WIDTH, GRAM = 50, 16
MOST_HOT = 50_000  # triggers that are told to all tasks; hot triggers have at least this part of all phrases


@dataclass(frozen=True)
class Tuning:
    """Sizes that steer memory, never the result."""

    cells: int = 800_000  # (trigger, text) of one block
    strings: int = 2_000_000  # of one block's dictionary
    unit: int = 12 << 20  # bytes of text whose phrases are sent once
    hot: int = 200_000  # phrases of one trigger, beyond which its strings are dealt one by one
    piece: int = 1 << 17  # bytes of whole triggers sorted at once
    chunk: int = 2 << 20  # bytes parsed at once
    name_bits: int = 64  # of a phrase's name; fewer make names clash, which costs time only


_BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def smallest_in(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i : i + w]) for each i, by doubling."""
    step = 1
    while step * 2 <= w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (w - step)], v[w - step :]) if step < w else v


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    pw, ip = powers(len(raw))
    acc = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * pw[: len(raw)], out=acc[1:])
    return mix((acc[width:] - acc[:-width]) * ip[: len(raw) - width + 1])


def phrases(raw: np.ndarray, off: np.ndarray, width: int, gram: int):
    """(trigger, row, first string, number of strings) of each phrase of the rows."""
    if len(raw) < width:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    trigger = smallest_in(rolling(raw, gram), width - gram + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(row[: len(trigger)] == row[width - 1 :])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    t, r = trigger[at], row[at]
    new = np.r_[True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]) | (at[1:] - at[:-1] != 1)]
    # a phrase of periodic text could go on for ever: cut it every 4 * width strings of its row
    new |= (at - off[r]) % (4 * width) == 0
    begin = np.flatnonzero(new)
    return t[begin], r[begin], at[begin], np.diff(np.r_[begin, len(at)])


def _pack(block: np.ndarray, columns: list[np.ndarray]):
    """Rows sorted by block, cut into one tuple (block, bytes of each column...) per block."""
    o = np.argsort(block, kind="stable")
    block = block[o]
    columns = [c[o] for c in columns]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
    for a, b in zip(cut, np.r_[cut[1:], len(block)].astype(int) if len(block) else [], strict=True):
        yield int(block[a]), [c[a:b] for c in columns]


def segments(column, width: int, most: int):
    """(row numbers, bytes, offsets, place of the first byte in its text) of about `most` bytes; a longer text comes in pieces that
    overlap by width - 1 bytes."""
    for first, raw, off in chunks(column, most):
        if len(raw) <= most or len(off) > 2:
            yield np.arange(first, first + len(off) - 1), raw, off, 0
            continue
        for a in range(0, max(1, len(raw) - width + 1), most):
            part = raw[a : a + most + width - 1]
            yield np.array([first]), part, np.array([0, len(part)]), a


def _bucket(docs: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _parse(width: int, gram: int, blocks: int, tuning: Tuning):
    """Step 1 of a task: cells (trigger, text, log2 of its phrases) by block, of kind 0; triggers that two texts of a chunk share are
    known at once and go to the texts' buckets, of kind 1."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names = b.column("doc_id").to_numpy()
            for index, raw, off, _ in segments(b.column("body"), width, tuning.chunk):
                t, r, _, _ = phrases(raw, off, width, gram)
                if not len(t):
                    continue
                h = names[index[r]]
                o = np.lexsort((h, t))
                t, h = t[o], h[o]
                begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                weight = np.log2(np.diff(np.r_[begin, len(t)])).astype(np.uint8)
                once = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]
                t, h = t[once], h[once]
                new = np.r_[True, t[1:] != t[:-1]]
                often = ~(new & np.r_[new[1:], True])
                rows = []
                texts, who = np.unique(h[new], return_inverse=True)
                for block, (ts, ws, n) in _pack((t[new] % np.uint64(blocks)).astype(np.int64), [t[new], who.astype(np.uint32), weight]):
                    here, at = np.unique(ws, return_inverse=True)
                    rows.append((block, 0, ts.tobytes(), at.astype(np.uint32).tobytes(), texts[here].tobytes(), n.tobytes()))
                for bucket, (ts, hs) in _pack(_bucket(h[often], blocks), [t[often], h[often]]):
                    here, at = np.unique(hs, return_inverse=True)
                    rows.append((bucket, 1, ts.tobytes(), at.astype(np.uint32).tobytes(), here.tobytes(), b""))
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "kind", "t", "who", "doc", "n"])

    return run


def _shared_triggers(hot: int, blocks: int):
    """Step 1 of a block: by bucket, the texts and their triggers that another text has too; in bucket -1 the triggers of over `hot` phrases."""
    import pyarrow as pa

    def run(table):
        t, h, n, out = [], [], [], []
        for x in table.to_pylist():
            if x["kind"]:
                out.append((x["block"], x["t"], x["who"], x["doc"]))
            else:
                t.append(np.frombuffer(x["t"], np.uint64))
                h.append(np.frombuffer(x["doc"], np.int64)[np.frombuffer(x["who"], np.uint32)])
                n.append(np.frombuffer(x["n"], np.uint8))
        if h:
            t, h, n = np.concatenate(t), np.concatenate(h), np.concatenate(n)
            o = np.argsort(t, kind="stable")
            t, h, n = t[o], h[o], n[o]
            new = np.r_[True, t[1:] != t[:-1]]
            starts = np.flatnonzero(new)
            common = np.add.reduceat(np.exp2(n.astype(float)), starts) > hot
            if common.any():
                out.append((-1, t[starts[common]].tobytes(), b"", b""))
            differ = np.maximum.reduceat(h, starts) != np.minimum.reduceat(h, starts)
            keep = differ[np.cumsum(new) - 1]
            for bucket, (ts, hs) in _pack(_bucket(h[keep], blocks), [t[keep], h[keep]]):
                here, at = np.unique(hs, return_inverse=True)
                out.append((bucket, ts.tobytes(), at.astype(np.uint32).tobytes(), here.tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 3)
        return pa.table({c: pa.array([x[j] for x in out], k) for j, (c, k) in enumerate(zip(("bucket", "t", "who", "doc"), kinds, strict=True))})

    return run


def _by_text(table):
    """Step 1 of a bucket of texts: one row (text, its shared triggers, in order) each."""
    import pyarrow as pa

    held = table.to_pylist()
    t = np.concatenate([np.frombuffer(x["t"], np.uint64) for x in held])
    h = np.concatenate([np.frombuffer(x["doc"], np.int64)[np.frombuffer(x["who"], np.uint32)] for x in held])
    o = np.lexsort((t, h))
    rows = [(name, ts.tobytes()) for name, (ts,) in _pack(h[o], [t[o]])]
    return pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "ts": pa.array([x[1] for x in rows], pa.binary())})


def grouped(raw: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, name and document; where a phrase of other bytes begins): phrases of one name are compared byte by byte."""
    o = np.lexsort((doc, name, key))
    new = np.r_[True, (name[o][1:] != name[o][:-1]) | (key[o][1:] != key[o][:-1])]
    lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    odd = size[o] != size[lead]
    check = np.flatnonzero(~new & ~odd)
    for k in range(0, len(check), 1 << 14):
        c = check[k : k + (1 << 14)]
        z = size[o[c]]
        begin = np.cumsum(z) - z
        step = np.arange(int(z.sum())) - np.repeat(begin, z)
        odd[c] = np.logical_or.reduceat(raw[np.repeat(at[o[c]], z) + step] != raw[np.repeat(at[lead[c]], z) + step], begin)
    if odd.any():
        part, seen = np.zeros(len(o), np.int64), {}
        for k in np.flatnonzero(np.isin(name, name[o][odd])).tolist():
            part[k] = seen.setdefault((int(key[k]), int(name[k]), raw[at[k] : at[k] + size[k]].tobytes()), len(seen))
        o = np.lexsort((doc, part, name, key))
        new = np.r_[True, (name[o][1:] != name[o][:-1]) | (key[o][1:] != key[o][:-1]) | (part[o][1:] != part[o][:-1])]
    return o, new


_DICT, _UNIT = 0, 1


def _dictionary(width: int, gram: int, blocks: int, hot: np.ndarray, tuning: Tuning):
    """Step 2 of a task: per unit, rows _DICT of its distinct phrases by block, and one row _UNIT of its parse.

    _DICT: first (number of the first phrase in the unit), a names, b smallest documents, c sizes, d bytes.
    _UNIT: a occurrences and b strings of each phrase, c text and d place of each occurrence, e ids and f hashes of the texts.
    """
    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6)

    def flush(uid, raws, cells, ids, hashes):
        raw = np.concatenate(raws)
        key, name, text, place, at, n = (np.concatenate(c) for c in zip(*cells, strict=True))
        ids, hashes = np.array(ids, np.int64), np.array(hashes, np.int64)
        size, block = n + width - 1, (key % np.uint64(blocks)).astype(np.int64)
        o, new = grouped(raw, at, size, block, name, ids[text])
        lead, begin = o[new], np.flatnonzero(new)
        u4 = lambda x: x.astype(np.uint32).tobytes()
        rows = []
        for number, (k, first) in _pack(block[lead], [lead, np.arange(len(lead))]):
            body = b"".join(raw[a : a + z].tobytes() for a, z in zip(at[k].tolist(), size[k].tolist(), strict=True))
            rows.append((_DICT, number, uid, int(first[0]), name[k].tobytes(), ids[text[k]].tobytes(), u4(size[k]), body, b"", b""))
        rows.append((_UNIT, -1, uid, 0, u4(np.diff(np.r_[begin, len(o)])), u4(n[lead]), u4(text[o]), u4(place[o]), ids.tobytes(), hashes.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "block", "uid", "first", "a", "b", "c", "d", "e", "f"])

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        raws, cells, ids, hashes, held = [], [], [], [], 0
        for b in batches:
            docs, names, shared = b.column("doc_id").to_numpy(), b.column("h").to_numpy(), b.column("ts")
            seen = -1
            for index, raw, off, base in segments(b.column("body"), width, tuning.chunk):
                if held >= tuning.unit and int(index[0]) != seen:  # the pieces of a text stay in one unit
                    yield flush(uid, raws, cells, ids, hashes)
                    uid += 1
                    raws, cells, ids, hashes, held = [], [], [], [], 0
                t, r, at, n = phrases(raw, off, width, gram)
                keep = np.zeros(len(t), bool)
                ends = np.searchsorted(r, np.arange(len(off)))
                for k, row in enumerate(index.tolist()):
                    known = np.frombuffer(shared[row].as_py(), np.uint64)
                    mine = t[ends[k] : ends[k + 1]]
                    if len(known) and len(mine):
                        keep[ends[k] : ends[k + 1]] = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                t, r, at, n = t[keep], r[keep], at[keep], n[keep]
                if not len(t):
                    continue
                if len(hot):
                    common = hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t
                    times = np.where(common, n, 1)
                    of = np.repeat(np.arange(len(t)), times)
                    at = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                    t, r, n, common = t[of], r[of], np.where(common, 1, n)[of], common[of]
                size = n + width - 1
                pw, ip = powers(len(raw))
                acc = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_BYTE[raw] * pw[: len(raw)], out=acc[1:])
                name = mix((acc[at + size] - acc[at]) * ip[at] + size.astype(np.uint64)) >> np.uint64(64 - tuning.name_bits)
                key = np.where(common, name, t) if len(hot) else t
                if int(index[0]) != seen:
                    first = len(ids)
                    ids += docs[index].tolist()
                    hashes += names[index].tolist()
                cells.append((key, name, first + r, base + at - off[r], held + at, n))
                raws.append(raw)
                held += len(raw)
                seen = int(index[-1])
        if cells:
            yield flush(uid, raws, cells, ids, hashes)

    return run


PIECE_BITS = 20


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks. Keys of up to 44 bits of up to 2**20 places are sorted together with their places, in one plain sort."""
    if len(keys) >> PIECE_BITS:
        return np.unique(keys, return_inverse=True)[1].astype(np.uint64)
    both = (keys << np.uint64(PIECE_BITS)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64)
    key = both >> np.uint64(PIECE_BITS)
    out = np.empty(len(keys), np.uint64)
    out[place] = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64)
    return out


def suffix_classes(raw: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the suffixes at `starts` by their first `width` bytes (equal rank, equal bytes): prefix doubling from 4-byte words."""
    padded = np.r_[raw, np.zeros(3, np.uint8)].astype(np.uint64)
    word = np.zeros(len(raw), np.uint64)
    for k in range(4):
        word = (word << np.uint64(8)) | padded[k : k + len(raw)]
    code, have = _ranks(word), 4
    shift = np.uint64(32 if len(raw) >> PIECE_BITS else PIECE_BITS)
    while have < width:
        far = min(have, width - have)
        after = np.zeros(len(code), np.uint64)
        after[: len(code) - far] = code[far:]
        code = _ranks((code << shift) | after)
        have += far
    return code[starts].astype(np.int64)


def _merge(width: int, gram: int, tuning: Tuning):
    """Step 3 of a block: the dictionary rows of all units -> per row: which of its phrases a smaller document outside the unit has
    whole, and of the others the runs of strings that start in a smaller document."""
    import pyarrow as pa

    def run(table):
        held = table.to_pylist()
        join = lambda c, kind: np.concatenate([np.frombuffer(x[c], kind) for x in held])
        name, doc, size = join("a", np.uint64), join("b", np.int64), join("c", np.uint32).astype(np.int64)
        raw = np.frombuffer(b"".join(x["d"] for x in held), np.uint8)
        at = np.cumsum(size) - size
        o, new = grouped(raw, at, size, np.zeros(len(name), np.int64), name, doc)
        lead = o[new]  # of each phrase, the smallest document
        phrase = np.empty(len(o), np.int64)
        phrase[o] = np.cumsum(new) - 1
        l_doc, l_size, l_at = doc[lead], size[lead], at[lead]
        trigger = np.empty(len(lead), np.uint64)
        for k in range(0, len(lead), 1 << 14):  # of each phrase's first string
            some = raw[l_at[k : k + (1 << 14), None] + np.arange(width)].ravel()
            trigger[k : k + (1 << 14)] = smallest_in(rolling(some, gram), width - gram + 1)[::width]
        n = l_size - width + 1
        smaller = np.zeros(int(n.sum()), bool)
        where = np.cumsum(n) - n
        # equal strings have equal triggers: the dictionary is sorted in pieces of whole triggers
        by = np.argsort(trigger, kind="stable")
        ends = np.cumsum(l_size[by])
        last = np.flatnonzero(np.r_[trigger[by][1:] != trigger[by][:-1], True])
        a = 0
        while a < len(by):
            base = ends[a - 1] if a else 0
            k = np.searchsorted(ends[last], base + tuning.piece, "right") - 1
            b = int(last[max(k, np.searchsorted(last, a))]) + 1
            part = by[a:b]
            z, m = l_size[part], n[part]
            body = raw[np.repeat(l_at[part] - (np.cumsum(z) - z), z) + np.arange(z.sum())]
            within = np.repeat(np.arange(len(part)), m)
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            code = suffix_classes(body, np.repeat(np.cumsum(z) - z, m) + step, width)
            first = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, code, l_doc[part][within])
            smaller[where[part][within] + step] = first[code] < l_doc[part][within]
            a = b
        total = np.r_[0, np.cumsum(smaller)]
        partly = total[where + n] > total[where]
        u4 = lambda x: x.astype(np.uint32).tobytes()
        out, begin = [], 0
        for x in held:
            mine = slice(begin, begin + len(x["a"]) // 8)
            begin = mine.stop
            p = phrase[mine]
            outside = doc[mine] > l_doc[p]
            k = np.flatnonzero(~outside & partly[p])
            m = n[p[k]]
            string = np.repeat(where[p[k]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            who = np.repeat(np.arange(len(k)), m)
            hit = np.flatnonzero(smaller[string])
            edge = np.r_[True, (hit[1:] - hit[:-1] != 1) | (who[hit][1:] != who[hit][:-1])] if len(hit) else np.zeros(0, bool)
            s = np.flatnonzero(edge)
            e = np.r_[s[1:], len(hit)] - 1 if len(hit) else s
            place = string[hit] - where[p[k]][who[hit]]
            if outside.any() or len(hit):
                out.append((x["uid"], x["first"], np.packbits(outside).tobytes(), len(p), u4(k[who[hit][s]]), u4(place[s]), u4(place[e])))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 3)
        return pa.table({c: pa.array([x[j] for x in out], k) for j, (c, k) in enumerate(zip(("uid", "first", "outside", "n", "k", "s", "e"), kinds, strict=True))})

    return run


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, b)."""
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.r_[True, a[1:] > b[:-1]] if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return a[first], b[np.r_[first[1:], len(a)] - 1] if len(a) else b


def _combine(width: int):
    """Step 4 of a unit: its parse and the answers to its phrases -> (document, hash of its text, first bytes, last bytes exclusive)."""
    import pyarrow as pa

    def run(key, unit, answers):
        u, found = unit.to_pylist(), answers.to_pylist()
        if not u or not found:
            return pa.table({"doc_id": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "aa": pa.array([], pa.binary()), "bb": pa.array([], pa.binary())})
        u4 = lambda x: np.frombuffer(x, np.uint32).astype(np.int64)
        times, n, text, place = (u4(u[0][c]) for c in "abcd")
        ids, hashes = np.frombuffer(u[0]["e"], np.int64), np.frombuffer(u[0]["f"], np.int64)
        outside = np.zeros(len(times), bool)
        run_of, run_s, run_e = [], [], []
        for x in found:
            outside[x["first"] : x["first"] + x["n"]] = np.unpackbits(np.frombuffer(x["outside"], np.uint8), count=x["n"]).astype(bool)
            run_of.append(u4(x["k"]) + x["first"])
            run_s.append(u4(x["s"]))
            run_e.append(u4(x["e"]))
        run_of, run_s, run_e = np.concatenate(run_of), np.concatenate(run_s), np.concatenate(run_e)
        begin = np.cumsum(times) - times
        phrase = np.repeat(np.arange(len(times)), times)
        doc = ids[text]
        later = doc > doc[begin][phrase]  # the first occurrence is in the unit's smallest document
        whole = np.flatnonzero(outside[phrase] | later)
        own = np.add.reduceat(~later, begin)[run_of]  # occurrences in that document, which come first
        ref = np.repeat(begin[run_of] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        shift = np.r_[text[whole], text[ref]] << 33
        a = shift + np.r_[place[whole], place[ref] + np.repeat(run_s, own)]
        b = shift + np.r_[place[whole] + n[phrase[whole]] + width - 1, place[ref] + np.repeat(run_e, own) + width]
        a, b = united(a, b)
        rows = [(int(ids[k]), int(hashes[k]), (s & 0x1FFFFFFFF).tobytes(), (e & 0x1FFFFFFFF).tobytes()) for k, (s, e) in _pack(a >> 33, [a, b])]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([x[j] for x in rows], k) for j, (c, k) in enumerate(zip(("doc_id", "h", "aa", "bb"), kinds, strict=True))})

    return run


def _cut():
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for doc, h, body, aa, bb in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("body"), batch.column("aa").to_pylist(), batch.column("bb").to_pylist(), strict=True):
                raw = body.as_buffer()
                raw = memoryview(raw) if raw is not None else memoryview(b"")
                a, b = np.frombuffer(aa, np.int64), np.frombuffer(bb, np.int64)
                digest, last = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    digest.update(raw[last:x])
                    last = y
                digest.update(raw[last:])
                rows.append((doc, h, int((b - a).sum()), len(a), digest.hexdigest()))
            if rows:
                kinds = (*[pa.int64()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "h", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH, gram: int = GRAM, tuning: Tuning = Tuning()) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts and texts under `width` bytes keep all they have. Rows that share an id are not smaller than each other. Rows with
    a null id are left out. Texts of any length are read whole. Extra columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("body")).where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("body"))
    described = stage(spark, rows.select("doc_id", "h", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha")), "texts")
    leads = stage(spark, described.groupBy("sha").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies")), "leads")
    described = stage(spark, skew_lookup(described, leads, ["sha"], "copies", described.count(), "doc_id"), "texts")
    copies = described.where("doc_id > lead").select("doc_id", "h")
    n_bytes, n_copies = described.agg(F.coalesce(F.sum(F.when(F.expr("doc_id = lead"), F.col("n_bytes"))), F.lit(0)), F.count_if(F.expr("doc_id > lead"))).first()
    rows = rows.where(F.octet_length("body") >= width).join(F.broadcast(copies) if n_copies <= BROADCAST_IDS else copies, ["doc_id", "h"], "left_anti")
    floor = 2 * spark.sparkContext.defaultParallelism

    blocks = max(floor, math.ceil(n_bytes / 18 / tuning.cells))
    cells = rows.select("doc_id", "body").mapInArrow(tidy(_parse(width, gram, blocks, tuning)), "block long, kind int, t binary, who binary, doc binary, n binary")
    shared = cells.repartition(blocks, "block").groupBy("block").applyInArrow(tidy_group(_shared_triggers(max(tuning.hot, n_bytes // 18 // MOST_HOT), blocks)), "bucket long, t binary, who binary, doc binary")
    shared = stage(spark, shared, "shared")
    weight = shared.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] / 8
    hot = np.sort(np.frombuffer(b"".join(r[0] for r in shared.where("bucket < 0").select("t").collect()), np.uint64))  # under 2 * MOST_HOT
    known = shared.where("bucket >= 0").repartition(blocks, "bucket").groupBy("bucket").applyInArrow(tidy_group(_by_text), "doc_id long, ts binary")

    blocks = max(floor, math.ceil(weight * 19 / tuning.strings))
    parsed = rows.join(known, "doc_id").select("doc_id", "h", "body", "ts").mapInArrow(tidy(_dictionary(width, gram, blocks, hot, tuning)), "kind int, block long, uid long, first long, a binary, b binary, c binary, d binary, e binary, f binary")
    parsed = stage(spark, parsed, "parsed")
    answers = parsed.where(F.col("kind") == _DICT).select("block", "uid", "first", "a", "b", "c", "d").repartition(blocks, "block").groupBy("block")
    answers = answers.applyInArrow(tidy_group(_merge(width, gram, tuning)), "uid long, first long, outside binary, n long, k binary, s binary, e binary")
    units = parsed.where(F.col("kind") == _UNIT).select("uid", "a", "b", "c", "d", "e", "f")
    spans = units.groupBy("uid").cogroup(answers.groupBy("uid")).applyInArrow(tidy_cogroup(_combine(width)), "doc_id long, h long, aa binary, bb binary")
    spans = stage(spark, spans.dropDuplicates(["doc_id", "h"]), "spans")

    few = spans.count() <= BROADCAST_IDS
    keys = spans.select("doc_id", "h")
    touched = rows.join(F.broadcast(keys) if few else keys, ["doc_id", "h"], "left_semi")
    cut = touched.join(spans, ["doc_id", "h"]).select("doc_id", "h", "body", "aa", "bb").mapInArrow(tidy(_cut()), "doc_id long, h long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "h"])
    found = described.join(cut, ["doc_id", "h"], "left")
    copy = (F.col("doc_id") > F.col("lead")) & (F.col("n_bytes") >= width)
    nothing = F.sha2(F.lit(""), 256)
    return found.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, documents(spark, sf_dir))
