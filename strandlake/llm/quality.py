"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Tokens are words and runs of punctuation, lower-cased and marked where a word
is in capitals; features are hashed one- and two-token grams (a token that
repeats its predecessor, or the one before that, gives one common gram), with log-scaled counts of unit
length. The weights are found by per-coordinate follow-the-regularised-leader
updates, one document at a time, on a bounded sample of labelled documents
(``SAMPLE``), in one task; a document's score is the sigmoid of a sparse dot
product with them. Scoring covers every row and every whole text.

Defined results: null and empty text has no features and scores the sigmoid of
the bias; labels that are null, or whose doc_id is null, are not learnt from;
without any label every score is 0.5; of repeated labels of a document each
counts; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import held_out, table

#: Weights, labelled documents learnt from at most, passes over them.
BUCKETS, SAMPLE, PASSES = 1 << 18, 12_000, 3
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint32(0x9E3779B1)


class _Tokens(dict):
    """Hash of a token; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        low = token.lower()
        h = zlib.crc32((low + "^" if token.isupper() and len(token) > 1 else low).encode("utf-8", "surrogatepass"))
        self[token] = h
        return h


def grams(text: object, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text's features."""
    found = _TOKEN.findall(text) if isinstance(text, str) else []
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    h = np.fromiter(map(tokens.__getitem__, found), np.uint32, len(found))
    two = (h[:-1] * _MIX) ^ (h[1:] + np.uint32(0x7F4A7C15))
    two[h[:-1] == h[1:]] = 0x5BD1E995  # a token that repeats its predecessor
    again = np.full(int((h[2:] == h[:-2]).sum()), 0x2C1B3C6D, np.uint32)  # or the one before that
    at, n = np.unique(np.concatenate([h, two * _MIX + np.uint32(1), again]) % np.uint32(BUCKETS), return_counts=True)
    x = np.log1p(n)
    return at.astype(np.int64), x / math.sqrt(float(x @ x))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after PASSES over (buckets, values, label)."""
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = bias = 0.0
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for k in rng.permutation(len(samples)):
            at, x, y = samples[k]
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ x) + bias)))) - y
            g, old = error * x, n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w[at]
            n[at] = new
            w[at] = np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(new)) / ALPHA + L2))
            grown = nb + error * error
            zb += error - (math.sqrt(grown) - math.sqrt(nb)) / ALPHA * bias
            nb = grown
            bias = -zb / ((BETA + math.sqrt(nb)) / ALPHA)
    return w, bias


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, y of at most ``most`` labels outside the held-out third, the same at every run; a row for each."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)  # bounded, so it may be broadcast
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # However often an id is repeated among the documents, one of its texts is learnt from.
    one = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc_id", "x.text", "y")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on a bounded sample; texts are hashed where they lie, one task updates the weights."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens()
        for pdf in batches:
            both = [grams(t, tokens) for t in pdf["text"].array]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "at": [a.astype(np.int32).tobytes() for a, _ in both], "x": [x.astype(np.float32).tobytes() for _, x in both]})

    def updated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32).astype(float), int(r.y)) for pdf in batches for r in pdf.itertuples()]
        w, bias = train(samples) if samples else (np.zeros(BUCKETS), 0.0)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [w[at].tobytes()], "bias": [bias]})

    rows = labelled_sample(docs, labels, "quality").mapInPandas(hashed, "doc_id long, y int, at binary, x binary")
    found = rows.repartition(1).sortWithinPartitions("doc_id", "y", "at").mapInPandas(updated, "at binary, w binary, bias double")
    w, bias = np.zeros(BUCKETS), 0.0
    for r in found.collect():  # one row of at most BUCKETS weights
        w[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["w"])
        bias = r["bias"]
    return w, bias


def scored(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """docs' doc_id and the columns ``keep``, with score."""
    w, bias = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, tokens = shared.value.astype(float), _Tokens()
        for texts in parts:
            out = []
            for t in texts.array:
                at, x = grams(t, tokens)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[at] @ x) + bias)))))
            yield pd.Series(out, dtype=float)

    return docs.select("doc_id", *keep, score(F.col("text").cast("string")).alias("score"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
