"""Toxicity: a weighted finite-state pattern grammar over clauses.

The words of a clause pass a cascade of transducers, composed into one machine whose states and arcs are made when they are first met:

* the lexicon reads a word and writes a symbol with a weight: insults (whole words and word beginnings, learnt from the labelled rows with
  a weight each), threats and targets (fixed words by language), negations, words of reporting, other words;
* negation rewrites insults and threats within two words after a negation;
* reported speech rewrites those that follow a word of reporting;
* target and threat remember the languages of the targets and threats met, since a target may come after what is said against it.

What the machine writes, and the state in which the clause ends, give the clause's weights by pattern: insults plain, targeted, negated or
reported, and threats against a target of their language. Pattern weights are fitted by logistic regression on the clauses of labelled
rows, so an isolated symbol has no score of its own. An Aho-Corasick automaton finds the clauses that hold any anchor; all other text
costs one scan.

The fit reads at most `MOST_LABELLED` labelled rows (those with the smallest hashes of their ids); scoring covers whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .quality import held_out, labelled_ids

MOST_LABELLED = 20_000
MOST_ENTRIES = 1000  # of the learnt lexicon
LEAST_ROWS, LEAST_SHARE = 4, 0.8
STEMS = (4, 5, 6)

# Fixed word lists.
THREATS = {"en": "kill murder destroy hurt", "fr": "tuer frapper", "de": "töten toten schlagen", "es": "matar golpear"}
TARGETS = {"en": "you your he she they them him her", "fr": "tu te toi vous ils il elle elles", "de": "du dich dir ihr sie er euch", "es": "tú tu te usted ustedes ellos ellas él"}
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't won't can't cannot pas jamais nicht kein keine keinen nie nunca".split()
REPORTS = "said says wrote quoted claimed dit dite sagte sagt dijo dice".split()
NEGATION_REACH = 2

PATTERNS = ["plain", "targeted", "negated", "reported", "threat"]
_CLAUSE = re.compile(r"[.!?;:\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Transducer:
    """Deterministic: arc(state, symbol) -> (next state, symbol written, weight). Arcs are kept once they have been made."""

    def __init__(self, start, arc):
        self.start, self._make, self._arcs = start, arc, {}

    def arc(self, state, symbol):
        found = self._arcs.get((state, symbol))
        if found is None:
            found = self._arcs[state, symbol] = self._make(state, symbol)
        return found

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what self writes, other reads; weights multiply."""

        def arc(state, symbol):
            p, written, w = self.arc(state[0], symbol)
            q, out, v = other.arc(state[1], written)
            return (p, q), out, w * v

        return Transducer((self.start, other.start), arc)

    def run(self, symbols):
        """(last state, [(symbol written, weight)])"""
        state, out = self.start, []
        for symbol, weight in symbols:
            state, written, w = self.arc(state, symbol)
            out.append((written, weight * w))
        return state, out


def _negation(state, symbol):
    """state: words that a negation still reaches."""
    left = max(0, state - 1)
    if symbol == ("negation",):
        return NEGATION_REACH, symbol, 1.0
    if state and symbol[0] in ("insult", "threat"):
        return left, ("negated", symbol[0]), 1.0
    return left, symbol, 1.0


def _reported(state, symbol):
    """state: whether a word of reporting has come."""
    if symbol == ("report",):
        return True, symbol, 1.0
    if state and symbol[0] in ("insult", "threat"):
        return True, ("reported", symbol[0]), 1.0
    return state, symbol, 1.0


def _remember(kind):
    """state: the languages of the symbols of that kind met so far."""

    def arc(state, symbol):
        return state | frozenset(symbol[1]) if symbol[0] == kind else state, symbol, 1.0

    return arc


def machine() -> Transducer:
    """negation, reported speech, target and threat, composed."""
    none = frozenset()
    return Transducer(0, _negation) @ Transducer(False, _reported) @ Transducer(none, _remember("target")) @ Transducer(none, _remember("threat"))


class Grammar:
    """The lexicon and the composed machine."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.symbols: dict[str, tuple] = dict.fromkeys(REPORTS, ("report",)) | dict.fromkeys(NEGATIONS, ("negation",))
        for kind, listed in (("target", TARGETS), ("threat", THREATS)):
            langs: dict[str, list] = {}
            for lang, line in listed.items():
                for w in line.split():
                    langs.setdefault(w, []).append(lang)
            self.symbols |= {w: (kind, tuple(v)) for w, v in langs.items()}
        self.machine = machine()
        self._found = None

    def __getstate__(self):
        return self.words, self.stems

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def anchors(self):
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *" ".join(THREATS.values()).split()}:
                self._found.add_word(w, len(w))
            self._found.make_automaton()
        return self._found

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEMS:
            found = max(found, self.stems.get(word[:n], 0.0)) if len(word) > n else found
        return found

    def read(self, word: str) -> tuple[tuple, float]:
        """The lexicon's arc: (symbol, weight). A short elided word before an apostrophe (l', qu') is left out."""
        for w in (word, word[word.find("'") + 1 :]) if 0 < word.find("'") <= 2 else (word,):
            weight = self.insult(w)
            if weight:
                return ("insult",), weight
            if w in self.symbols:
                return self.symbols[w], 1.0
        return ("word",), 1.0

    def clause(self, text: str) -> dict[str, float]:
        """Weights by pattern of one lower-cased clause; empty where nothing is said against anyone."""
        state, out = self.machine.run(self.read(m.group()) for m in _WORD.finditer(text))
        (_, targets), threats = state
        found: dict[str, float] = {}
        for symbol, weight in out:
            if symbol[0] == "insult":
                pattern = "targeted" if targets else "plain"
            elif symbol[-1] == "insult":
                pattern = symbol[0]
            else:
                continue
            found[pattern] = found.get(pattern, 0.0) + weight
        hits = sum(1.0 for symbol, _ in out if symbol[0] == "threat" and targets & frozenset(symbol[1]))
        return found | ({"threat": hits} if threats and hits else {})

    def clauses(self, text: str):
        """(start, end, {pattern: weight}) of the clauses that match, found from the anchors."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case: keep the places
            low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
        low = low.replace("\u2019", "'")
        done = 0
        for last, n in self.anchors.iter(low):
            a = last - n + 1
            if a < done or (a and low[a - 1].isalpha()):
                continue
            stop = _CLAUSE.search(low, last + 1)
            end = stop.start() if stop else len(low)
            start = max([done, *(low.rfind(c, done, a) + 1 for c in ".!?;:\n|")])
            found = self.clause(low[start:end])
            if found:
                yield start, end, found
            done = end

    def features(self, hits) -> list[float]:
        """Sums of clause weights by pattern, damped, and whether there is any."""
        total = dict.fromkeys(PATTERNS, 0.0)
        for _, _, found in hits:
            for kind, weight in found.items():
                total[kind] += weight
        return [math.log1p(total[p]) for p in PATTERNS] + [float(any(total.values()))]

    def describe(self, text: str | None) -> list[float]:
        return self.features(self.clauses(text or ""))


def _tokens(text: str) -> set[str]:
    words = {w.lower() for w in _WORD.findall(text.replace("\u2019", "'"))}
    words |= {w[w.find("'") + 1 :] for w in words if 0 < w.find("'") <= 2}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """rows: text, y -> the words and word beginnings that mark label 1, with weights. Counted on executors; at most MOST_ENTRIES return."""
    import pyarrow as pa

    def count(batches):
        pos, neg = Counter(), Counter()

        def give():
            keys = list({*pos, *neg})
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["token", "pos", "neg"])

        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                (pos if y else neg).update(_tokens(t or ""))
                if len(pos) + len(neg) > 500_000:
                    yield give()
                    pos.clear()
                    neg.clear()
        yield give()

    n = {bool(r[0]): r[1] for r in rows.groupBy("y").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    counts = rows.select("text", "y").mapInArrow(count, "token string, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = (F.col("pos") + 0.5) / (n1 + 1) / ((F.col("neg") + 0.5) / (n0 + 1))
    kept = counts.where((F.col("pos") >= LEAST_ROWS) & (F.col("pos") >= LEAST_SHARE * (F.col("pos") + F.col("neg")))).withColumn("odds", odds)
    words, stems = {}, {}
    for token, _, _, ratio in kept.orderBy(F.desc("pos"), F.desc("odds"), "token").limit(MOST_ENTRIES).collect():
        if token.endswith("*"):
            stems[token[:-1]] = math.log(ratio)
        else:
            words[token] = math.log(ratio)
    # a stem covered by a shorter one, or that only one learnt word has, says nothing more
    stems = {s: v for s, v in stems.items() if not any(s[:k] in stems for k in STEMS if k < len(s))}
    stems = {s: v for s, v in stems.items() if not any(w.startswith(s) for w in words) or sum(w.startswith(s) for w in words) > 2}
    words = {w: v for w, v in words.items() if not any(w[:k] in stems for k in STEMS if k < len(w))}
    return words, stems


def fit_patterns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (last: intercept), never negative for a pattern, with a small ridge. A pattern that is not seen weighs 1."""
    a = np.c_[x, np.ones(len(x))]
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    w = np.r_[np.ones(x.shape[1]), math.log(rate / (1 - rate))]
    if len(y) < 8 or y.min() == y.max():
        w[-1] = min(w[-1], -1.0)
        return w
    prior = np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.5 * (w - prior) * np.r_[np.ones(x.shape[1]), 0]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(np.r_[np.full(x.shape[1], 0.5), 1e-6]) + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Grammar, list[float]]:
    import pyarrow as pa

    ids = labelled_ids(labels, "toxic", 5, 0, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select("l_id", "text", "y")
    grammar = Grammar(*learn_lexicon(rows))

    def run(batches):
        for b in batches:
            x = [grammar.describe(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("l_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["l_id", "y", "x"])

    data = rows.mapInArrow(run, "l_id long, y double, x array<double>").orderBy("l_id").limit(2 * most).collect()
    x = np.array([r["x"] for r in data], float).reshape(-1, len(PATTERNS) + 1)
    return grammar, fit_patterns(x, np.array([r["y"] for r in data], float)).tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, clauses (start, end, pattern, weight of those that match).

    Null and empty texts have no clauses and score the intercept alone, like any text where nothing matches. Without labels of both
    classes the lexicon is empty and only threats match. Repeated rows get equal scores; a null id is not held out; extra columns are
    not read; an empty table stays empty.
    """
    import pyarrow as pa

    grammar, w = fit_toxicity(docs, labels)

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                scores, found = [], []
                for t in part.column("body").to_pylist():
                    hits = list(grammar.clauses(t or ""))
                    x = [*grammar.features(hits), 1.0]
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(p * q for p, q in zip(x, w, strict=True)))))))
                    found.append([f"{a}:{e}:{kind}:{weight:.3f}" for a, e, by in hits for kind, weight in by.items()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "score", "clauses"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("body")).mapInArrow(run, "doc_id long, score double, clauses array<string>")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
