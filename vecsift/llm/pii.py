"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, schemes, digits and identifier cues. Deterministic local parsers
then expand from each anchor to the boundaries of an email address, a network address, a card or phone number, or an account number, and
validate what they found. Nothing but the neighbourhood of an anchor is looked at.

The four base kinds give exactly the leftmost, non-overlapping matches of
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)       each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                      12 to 19 digits that pass Luhn's check
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 9 to 15 digits
where a match that fails its check is dropped and not tried again. Two kinds are added:
    account  where no base span is, a cue such as "account" or "iban", then, as the first word of its sentence with digits, an identifier of
             6 to 34 letters and digits with at least 6 digits (an IBAN must have a right check number)
    url      a scheme with user:password@ before its host (base spans inside it stay)
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ["email", "ip", "card", "phone", "account", "url"]
# Cues that announce an account or identity number (en, fr, de, es).
CUES = ["account", "acct", "iban", "passport", "ssn", "compte", "konto", "cuenta"]
# Short forms whose dot ends no sentence.
SHORT = ["no", "nr", "num", "acct"]
_WORD_OR_END = re.compile(r"[A-Za-z0-9]+|[\n.!?]")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")


@cache
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "d")
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", ":")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, f"c{len(form)}")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(t: str, ats: list[int]):
    limit = 0
    for p in ats:
        a = p
        while a > limit and t[a - 1] in _LOCAL:
            a -= 1
        if a == p:
            continue
        e, dots, label = p + 1, 0, 0
        end = 0
        while e < len(t):
            if t[e] in _LABEL:
                label += 1
                e += 1
                if dots:
                    end = e
            elif t[e] == "." and label:
                dots, label = dots + 1, 0
                e += 1
            else:
                break
        if end:
            yield a, end
            limit = end


def _runs(places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def ips(t: str, runs):
    i = 0
    while i + 3 < len(runs):
        if all(runs[k][1] + 1 == runs[k + 1][0] and t[runs[k][1]] == "." for k in range(i, i + 3)):
            parts = [t[a:b].lstrip("0") for a, b in runs[i : i + 4]]
            if all(len(x) < 4 and int(x or "0") <= 255 for x in parts):
                yield runs[i][0], runs[i + 3][1]
            i += 4
        else:
            i += 1


def cards(t: str, runs):
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and t[runs[j][1]] in " -":
            j += 1
        n = sum(b - a for a, b in runs[i : j + 1])
        if 12 <= n <= 19 and luhn("".join(t[a:b] for a, b in runs[i : j + 1])):
            yield runs[i][0], runs[j][1]
        i = j + 1


def phones(t: str, plus: list[int]):
    for p in plus:
        if p + 1 >= len(t) or t[p + 1] not in _DIGITS:
            continue
        e, last = p + 2, 0
        digits, n = 1, 1
        while e < len(t) and t[e] in _PHONE:
            if t[e] in _DIGITS:
                n += 1
                if e >= p + 3:
                    last, digits = e + 1, n
            e += 1
        if last and 9 <= digits <= 15:
            yield p, last


def accounts(t: str, cues: list[tuple[int, int]]):
    done = 0
    for a, b in cues:
        if a and t[a - 1].isalpha() or b < len(t) and t[b].isalpha() or b <= done:  # the cue before has been here
            continue
        s, last, end = len(t), t[a:b], b
        done = s
        for m in _WORD_OR_END.finditer(t, b):
            w = m.group()
            if w in "\n.!?":
                if w == "." and m.start() == end and last.lower() in SHORT:
                    continue
                done = m.start()
                break
            last, end = w, m.end()
            # a few capitals may be parted from the digits, as an IBAN's country
            parted = len(w) <= 4 and w.isalpha() and w.isupper() and w.lower() not in SHORT and t[end : end + 1] in (" ", "-") and t[end + 1 : end + 2] in _DIGITS
            if parted or not w.isalpha():
                done = m.start()
                s = done + next(k for k, c in enumerate(w) if c.isdigit() or c.isupper())
                break
        e, kept, end = s, [], s
        while e < len(t) and len(kept) < 35 and (t[e] in _ALNUM or (t[e] in " -" and e + 1 < len(t) and t[e + 1] in _DIGITS)):
            if t[e] in _ALNUM:
                kept.append(t[e])
                end = e + 1
            e += 1
        code = "".join(kept)
        if 6 <= len(code) <= 34 and sum(c in _DIGITS for c in code) >= 6:
            if code[:2].isalpha() and code[2:4].isdigit() and len(code) >= 15 and not iban_ok(code.upper()):
                continue
            yield s, end


def urls(t: str, schemes: list[int]):
    """schemes: places of '://'."""
    for p in schemes:
        a = p
        while a and t[a - 1] in _ALNUM:
            a -= 1
        e = p + 3
        while e < len(t) and not t[e].isspace() and t[e] not in "/\"'<>":
            e += 1
        host = t[p + 3 : e]
        user, at, name = host.rpartition("@")
        if a < p and at and ":" in user and "." in name:
            yield a, e


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each (start, end, kind) by start and then kind as listed; code points, end exclusive."""
    t = text or ""
    ats, plus, digits, schemes, cues = [], [], [], [], []
    for last, what in anchors().iter(t):
        if what == "d":
            digits.append(last)
        elif what == "@":
            ats.append(last)
        elif what == "+":
            plus.append(last)
        elif what == ":":
            schemes.append(last - 2)
        else:
            cues.append((last + 1 - int(what[1:]), last + 1))
    runs = _runs(digits)
    base = [(a, b, kind) for kind, found in (("email", emails(t, ats)), ("ip", ips(t, runs)), ("card", cards(t, runs)), ("phone", phones(t, plus))) for a, b in found]
    key = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=key)
    more: list[tuple[int, int, str]] = []
    for a, b in accounts(t, cues):
        if not any(a < y and x < b for x, y, _ in [*base, *more]):
            more.append((a, b, "account"))
    more += [(a, b, "url") for a, b in urls(t, schemes)]
    return base, sorted([*base, *more], key=key) if more else base


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans (the digest is that of the empty string). Rows that repeat get equal results; texts of any length
    are read whole; extra columns are not read; an empty table stays empty.
    """
    import pyarrow as pa

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                rows = []
                for t in part.column("body").to_pylist():
                    base, spans = find_spans(t)
                    kinds = [s[2] for s in base]
                    rows.append((*[kinds.count(x) for x in KINDS[:4]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").alias("body")).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
