"""Toxicity: a Levenshtein automaton run over a lexicon trie, and scores of the hits' contexts.

The lexicon holds terms found in labelled documents: whole words and word
beginnings that occur in many toxic and hardly any other documents, with a
short stated list of insults beside them. Its terms form a trie; a set of
(trie node, edits) pairs is one state of the Levenshtein automaton intersected
with that trie, and states are determinised as words are read, so that a word
costs one table lookup a letter and most words die after a few letters. Whole
terms of five letters or more may differ by one edit, of nine or more by two;
word beginnings must match exactly.

Each hit is read with the ``CONTEXT`` words on either side: quotation marks
and words of reporting or naming (said, word, called) speak for quotation,
address (you, your) and further hits for abuse. The counts of hits by kind and
context feed a logistic regression fitted on at most ``SAMPLE`` labelled
documents; scoring covers every row and every whole text.

Defined results: null and empty text has no hits and scores the sigmoid of the
bias; labels that are null or whose doc_id is null are not learnt from; without
any label the lexicon is the stated list and the weights are the stated prior;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import held_out, table
from strandlake.llm.quality import labelled_sample

#: Labelled documents learnt from at most, documents a term must occur in.
SAMPLE, SUPPORT = 12_000, 4
#: A term's toxic documents must outweigh the others by this factor of rates.
ODDS = 20.0
#: Words on either side of a hit.
CONTEXT = 8
#: States that the determinised automaton keeps.
STATES = 50_000

#: Log odds that a hit speaks for at most, and that of a stated term or of one with edits.
MOST_ODDS, STATED_ODDS, NEAR_ODDS = 6.0, 4.0, 3.0

#: General insults, known whatever the labels show.
STATED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard")
REPORTING = frozenset("said says say saying called calling word words term quote quoted quotes wrote writes meaning means defined definition phrase insult insults slur".split())
ADDRESS = frozenset("you your you're youre yourself u ur".split())

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTE = re.compile(r"[\"“”«»„]")
FEATURES = ("exact", "near", "stem", "evidence", "quoted", "address", "company", "density", "any", "several")
#: Weights before any label is seen, bias last.
PRIOR = (1.5, 1.0, 1.0, 0.5, -1.0, 0.5, 0.5, 0.5, 1.5, 1.0, -3.0)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie and determinised on the way.

    terms: (text, True for a whole word, False for a word's beginning).
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.most: list[int] = [-1]  # edits allowed to a whole term that ends below a node
        self.ends: list[int] = [-1]  # edits allowed to the whole term that ends here
        self.stem: list[bool] = [False]
        for text, whole in terms:
            allowed = edits_allowed(text) if whole else 0
            node = 0
            for c in text:
                self.most[node] = max(self.most[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.most.append(-1), self.ends.append(-1), self.stem.append(False)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
            if whole:
                self.ends[node] = max(self.ends[node], allowed)
            else:
                self.stem[node] = True
        self.alphabet = frozenset(c for kids in self.children for c in kids)
        self._start()

    def _start(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.verdict: list[int] = []
        self.stems: list[bool] = []
        self.dead = self._state(frozenset())
        self.first = self._state(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """With the letters that a word may leave out."""
        todo = list(best)
        while todo:
            node = todo.pop()
            e = best[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < best.get(child, 99):
                    best[child] = e
                    todo.append(child)
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            ends = [e for node, e in pairs if e <= self.ends[node]]
            self.verdict.append(min(ends) if ends else -1)
            self.stems.append(any(e == 0 and self.stem[node] for node, e in pairs))
        return self.ids[pairs]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node] and e + 1 < best.get(node, 99):
                best[node] = e + 1  # a letter too many
            for d, child in self.children[node].items():
                cost = e + (d != c)
                if cost <= self.most[child] and cost < best.get(child, 99):
                    best[child] = cost
        return self._state(self._closed(best))

    def match(self, word: str) -> int:
        """0 for no term, 1 exact, 2 within the allowed edits, 3 for a word's beginning."""
        if len(self.sets) > STATES:
            self._start()
        state, stem = self.first, False
        for c in word:
            c = c if c in self.alphabet else "\0"
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._step(state, c)
            state = moves[c]
            stem = stem or self.stems[state]
            if state == self.dead:
                break
        v = self.verdict[state]
        return 1 if v == 0 else 2 if v > 0 else 3 if stem else 0


class Reader:
    """Hits and features of whole texts; remembers the words it has matched, up to a bound."""

    def __init__(self, terms: dict[tuple[str, bool], float]):
        self.automaton, self.known, self.odds = Automaton(list(terms)), {}, terms

    def weight(self, word: str, kind: int) -> float:
        if kind == 1:
            return self.odds[word, True]
        return NEAR_ODDS if kind == 2 else max(self.odds.get((word[:k], False), 0.0) for k in range(1, len(word) + 1))

    def kind(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            if len(self.known) > 300_000:
                self.known.clear()
            k = self.known[word] = self.automaton.match(word)
        return k

    def features(self, text: object) -> np.ndarray:
        x = np.zeros(len(FEATURES))
        if not isinstance(text, str) or not text:
            return x
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[i:j].lower() for i, j in spans]
        kinds = np.fromiter(map(self.kind, words), np.int64, len(words))
        hits = np.flatnonzero(kinds)
        if not len(hits):
            return x
        quoted = address = company = 0
        for h in hits.tolist():
            lo, hi = max(0, h - CONTEXT), min(len(words), h + CONTEXT + 1)
            near = words[lo:hi]
            marks = len(_QUOTE.findall(text, spans[lo][0], spans[h][0])) % 2 == 1 and _QUOTE.search(text, spans[h][1], spans[hi - 1][1] + 1) is not None
            quoted += marks or any(w in REPORTING for w in near)
            address += any(w in ADDRESS for w in near)
            company += int((kinds[lo:hi] > 0).sum()) > 1
        n = len(hits)
        evidence = math.log1p(sum(self.weight(words[h], int(kinds[h])) for h in hits.tolist()))
        return np.array([*(math.log1p(int((kinds == k).sum())) for k in (1, 2, 3)), evidence, quoted / n, address / n, company / n, math.log1p(1000 * n / len(words)) / 4, 1.0, float(n - quoted > 1)])


def lexicon(sample: DataFrame) -> dict[tuple[str, bool], float]:
    """Log odds of (term, whole word): stated terms, and all that the sample's labels single out; stems cover the words that begin with them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, y in zip(pdf["text"].array, pdf["y"].array, strict=True):
                words = {w.lower() for w in _WORD.findall(text)} if isinstance(text, str) else set()
                found = {(w, True) for w in words if 4 <= len(w) <= 24} | {(w[:k], False) for w in words for k in range(4, min(9, len(w)))}
                rows += [(t, whole, int(y)) for t, whole in found]
            yield pd.DataFrame(rows, columns=["term", "whole", "y"])

    own = sample.mapInPandas(counted, "term string, whole boolean, y int")
    n = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic, other = n["t"] or 0, (n["n"] or 0) - (n["t"] or 0)
    if not toxic or not other:
        return {(t, True): STATED_ODDS for t in STATED}
    t, c = F.col("t"), F.col("c") - F.col("t")
    odds = (t + 0.5) / (toxic + 1) / ((c + 0.5) / (other + 1))
    best = own.groupBy("term", "whole").agg(F.sum("y").cast("long").alias("t"), F.count("*").alias("c")).filter((t >= SUPPORT) & (odds >= ODDS)).orderBy(t.desc(), "whole", "term").collect()  # no more than the texts of SAMPLE rows have
    stems: list[str] = []
    for r in sorted((r for r in best if not r["whole"]), key=lambda r: len(r["term"])):
        if not any(r["term"].startswith(s) for s in stems):
            stems.append(r["term"])
    whole = [r["term"] for r in best if r["whole"]]
    # A stem that only one known word begins with says no more than that word.
    stems = [s for s in stems if sum(w.startswith(s) for w in whole) != 1]
    kept = [w for w in whole if not any(w.startswith(s) for s in stems)]
    log_odds = {(r["term"], r["whole"]): min(MOST_ODDS, math.log((r["t"] + 0.5) / (toxic + 1) / ((r["c"] - r["t"] + 0.5) / (other + 1)))) for r in best}
    return {(t, True): STATED_ODDS for t in STATED} | {k: log_odds[k] for k in [*((w, True) for w in kept), *((s, False) for s in stems)]}


def regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a ridge-penalised logistic regression (Newton steps) around PRIOR."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.array(PRIOR)
    if len(y) == 0 or y.min() == y.max():
        return w
    prior = w.copy()

    def loss(w: np.ndarray) -> float:
        m = np.where(y > 0, 1, -1) * (x @ w)
        return float(np.logaddexp(0, -m).sum() + 0.5 * ((w - prior) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step, now, rate = np.linalg.solve(hessian, x.T @ (p - y) + w - prior), loss(w), 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """docs' doc_id and the columns ``keep``, with score."""
    sample = labelled_sample(docs, labels, "toxic", SAMPLE)
    terms = lexicon(sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(terms)
        for pdf in batches:
            x = np.array([reader.features(t) for t in pdf["text"].array]).reshape(-1, len(FEATURES))
            yield pd.DataFrame(x, columns=FEATURES).assign(y=pdf["y"].to_numpy())

    seen = sample.mapInPandas(features, ", ".join(f"{f} double" for f in FEATURES) + ", y int").toPandas()  # at most SAMPLE rows of numbers
    seen = seen.sort_values(list(seen.columns))
    w = regress(seen[list(FEATURES)].to_numpy(float), seen["y"].to_numpy(float))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(terms)
        for texts in parts:
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, float(reader.features(t) @ w[:-1] + w[-1]))))) for t in texts.array], dtype=float)

    return docs.select("doc_id", *keep, score(F.col("text").cast("string")).alias("score"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
