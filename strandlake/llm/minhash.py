"""Near-duplicate documents: banded MinHash candidates under sequential Bayesian verification.

Every document becomes the set of its distinct five-word shingles. Documents of
one set are collapsed to a class at once. Classes meet in the buckets of banded
MinHash signatures; a candidate pair's signatures are compared batch by batch
and dropped as soon as the posterior probability that the similarity reaches
the threshold falls under ``MISS``; survivors are confirmed on their full sets.

No bucket is expanded into all of its pairs. In rounds, each class is tried
against the one bucket head it shares most bands with, heads changing from
round to round; this joins large groups of copies into components with one
comparison per member and round. Then every pair that shares a bucket and is
still in different components is compared, in slices that widen, with
components found anew after each, so no link that could join two
components is passed over; pairs are left out only where bounds on their
intersection rule a link out: a histogram of each set over ``CELLS`` cells, and
the number of shingles that no other document at hand has.

Classes have numbers of their own; ids of documents come back at the end, as
the smallest of each component.

Defined results: null or wordless text is an empty set, linked with nothing
(its component is its own id); fewer than five words are one shingle; repeated
rows of one doc_id get a row each, and if their texts differ each is linked by
its own text, its doc_id counting wherever one of its texts is; a row with null
doc_id is linked with nothing and keeps a null component; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import BROADCAST_IDS, U64, Scratch, WordHashes, as_bytes, cut, mixed, rolling, table

SHINGLE = 5
#: 100 * intersection >= PERCENT * union links two documents, unless another percentage is given.
PERCENT = 85
#: Chosen probability that a pair at the threshold shares no band, and hash functions at most.
NO_BAND, PERMUTATIONS = 3e-7, 200
#: Cells of the histogram that bounds intersections.
CELLS = 128
#: Rounds of one trial per class go on while they halve the pairs left and more than this are left per class.
PAIRS_PER_CLASS = 1
#: Each slice of the pairs that are left takes up to so many times what was taken before it.
WIDER = 8
#: Chosen probability to prune a pair that reaches the threshold, per batch of BATCH hashes.
MISS, BATCH = 1e-7, 32

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.int64).astype(U64)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that still miss a pair at the threshold with NO_BAND at most; 32 of 6 at 85."""
    for rows in range(6, 0, -1):
        bands = math.ceil(math.log(NO_BAND) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1
        if bands * rows <= PERMUTATIONS:
            return bands, rows
    raise ValueError(f"no banding for {percent} percent")


def shingle_set(text: object, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.empty(0, U64)
    h = hashes.array(words)
    if len(words) < SHINGLE:
        return mixed(rolling(h, len(h)) + U64(len(h)))
    return np.unique(mixed(rolling(h, SHINGLE)))


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """MinHash signature of a set under n functions, by blocks so that memory is bounded for very long texts."""
    least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 4096):
        h = (shingles[i : i + 4096, None] * _MUL[:n] + _ADD[:n]) >> U64(32)
        np.minimum(least, h.min(axis=0).astype(np.uint32), out=least)
    return least


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number n of compared hashes, the fewest matches that are not pruned.

    With a uniform prior the posterior of the similarity after m of n matches is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(PERMUTATIONS + 1):
        below, m = 0.0, -1
        while below < miss and m <= n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survives(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of two signature matrices that no batch prunes; pruned rows are not compared further."""
    alive, matches, n = np.arange(len(a)), np.zeros(len(a), np.int64), a.shape[1]
    for i in range(0, n, BATCH):
        matches[alive] += (a[alive, i : i + BATCH] == b[alive, i : i + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= least[min(n, i + BATCH)]]
    return alive


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, hashes_: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), signature, shingles per cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                s = shingle_set(text, hashes)
                full = len(s) > 0
                rows.append((doc_id, len(s), set_digest(s) if full else None, signature(s, hashes_).tobytes() if full else None, np.bincount((s >> U64(40)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sig", "cells"]).astype({"doc_id": "Int64"})

    return _named(docs).mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig binary, cells array<int>")


def bands(reps: DataFrame, percent: int) -> DataFrame:
    """A row (key, doc, n) for each class and band."""
    n_bands, rows = banding(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), n_bands, rows).astype(U64)
            key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=U64), sig.shape[:2]).copy()
            for r in range(rows):
                key = mixed(key * U64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pd.DataFrame({"key": key.ravel().view(np.int64), "doc": np.repeat(pdf["doc"].to_numpy(), n_bands), "n": np.repeat(pdf["n_shingles"].to_numpy(), n_bands)})

    return reps.select("doc", "n_shingles", "sig").mapInPandas(run, "key long, doc long, n long")


def sizes_allow(a: str, b: str, percent: int) -> "F.Column":
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, s: the full set of each class among wanted (doc), from a text of the document that the class is known by."""
    ids = reps.join(wanted, "doc", "left_semi").select("doc_id", "doc", "digest")
    small = ids.count() <= BROADCAST_IDS

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for doc, digest, text in zip(pdf["doc"].array, pdf["digest"].array, pdf["text"].array, strict=True):
                s = shingle_set(text, hashes)
                if set_digest(s) == bytes(digest):  # else another text of that document
                    rows.append((doc, s.tobytes()))
            yield pd.DataFrame(rows, columns=["doc", "s"]).astype({"doc": "int64"})

    found = _named(docs).join(F.broadcast(ids) if small else ids, "doc_id").select("doc", "digest", "text").mapInPandas(shingles, "doc long, s binary")
    return found.groupBy("doc").agg(F.first("s").alias("s"))


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(doc, u): how many shingles of each of the sets (doc, s) are in no other of them."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                found = [np.frombuffer(s, np.int64) for s in part["s"]]
                yield pd.DataFrame({"doc": np.repeat(part["doc"].to_numpy(np.int64), [len(x) for x in found]), "s": np.concatenate(found)})

    rows = sets.mapInPandas(shingles, "doc long, s long")
    return rows.groupBy("s").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).filter("doc = last").groupBy("doc").agg(F.count("*").alias("u"))


def known_allow(n: str, e: str, other_n: str, other_e: str, percent: int) -> "F.Column":
    """Whether sets of n shingles, of which at most e occur in any other set, can be similar enough."""
    most = F.least(e, other_e)
    return most * (100 + percent) >= (F.col(n) + F.col(other_n)) * percent


def cells_allow(n: str, cells: str, other_n: str, other_cells: str, percent: int) -> "F.Column":
    """Whether two sets can be similar enough: what they share lies in the same cells of both."""
    most = F.aggregate(F.zip_with(cells, other_cells, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    return most * (100 + percent) >= (F.col(n) + F.col(other_n)) * percent


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, scratch: Scratch, sets: DataFrame | None = None) -> DataFrame:
    """Of candidate pairs (a, b) those that the signatures keep and the full sets confirm. sets (doc, s), if given, holds those of all classes that pairs name."""
    least = least_matches(percent)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
                yield pdf.iloc[survives(a, b, least)][["a", "b"]]

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["s_a"], pdf["s_b"], strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf[np.array(keep, bool)][["a", "b"]]

    def with_both(found: DataFrame, df: DataFrame, value: str) -> DataFrame:
        a, b = (df.select(F.col("doc").alias(c), F.col(value).alias(f"{value}_{c}")) for c in "ab")
        return found.join(a, "a").join(b, "b").select("a", "b", f"{value}_a", f"{value}_b")

    kept = with_both(pairs, reps, "sig").mapInPandas(prune, "a long, b long")
    if sets is not None:
        return scratch.cut(with_both(kept, sets, "s").mapInPandas(confirm, "a long, b long"), "op5-links")
    kept = scratch.cut(kept, "op5-survivors")
    wanted = kept.select(F.col("a").alias("doc")).union(kept.select("b")).distinct()
    sets = scratch.cut(sets_of(docs, reps, wanted), "op5-sets")
    links = scratch.cut(with_both(kept, sets, "s").mapInPandas(confirm, "a long, b long"), "op5-links", sets)
    scratch.drop(id(kept))
    return links


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, component) for each end of edges (a, b); component: the smallest v that can be reached.

    Every node points to its smallest neighbour, pointers are followed to their
    ends by doubling, and the graph is contracted, until no edge is left. Each
    round leaves half of the nodes at most, and a path in order takes one.
    """
    around = edges.filter("a <> b")
    graph = scratch.cut(around.union(around.select("b", "a")).distinct(), "cc-graph")
    labels = None
    while True:
        # A node is a component's name or has a smaller neighbour; every pointer's end is a node, too.
        step, first = None, graph.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to"))
        while True:
            now, told = first if step is None else step, Observation()
            ahead = now.select(F.col("v").alias("to"), F.col("to").alias("then"))
            jumped = now.join(ahead, "to").select("v", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")).observe(told, F.count_if("moved").alias("n"))
            step = scratch.cut(jumped, "cc-step", step)
            if not told.get["n"]:
                break
        if labels is None:
            labels = scratch.cut(step.select("v", F.col("to").alias("component")), "cc-labels")
        else:
            further = step.select(F.col("v").alias("component"), "to")
            labels = scratch.cut(labels.join(further, "component", "left").select("v", F.coalesce("to", "component").alias("component")), "cc-labels", labels)
        ends, told = [step.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")], Observation()
        left = graph.join(ends[0], "a").join(ends[1], "b").filter("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        graph = scratch.cut(left.observe(told, F.count("*").alias("n")), "cc-graph", graph)
        scratch.drop(id(step))
        if not told.get["n"]:
            scratch.drop(id(graph))
            return labels


def joined_up(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (v, component) as further links (a, b) join components; only these become nodes, and v that had no link."""
    named = links
    for c in "ab":
        named = named.join(labels.select(F.col("v").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(c, F.coalesce(f"{c}_in", c)).drop(f"{c}_in")
    further = components(named.select("a", "b"), scratch)
    moved = labels.join(further.select(F.col("v").alias("component"), F.col("component").alias("to")), "component", "left").select("v", F.coalesce("to", "component").alias("component"))
    out = scratch.cut(moved.unionByName(further.join(labels, "v", "left_anti")), "op5-components", labels)
    scratch.drop(id(further))
    return out


def stars(placed: DataFrame, turn: int, percent: int, scratch: Scratch) -> DataFrame:
    """One pair (a, b) for each class: with the head it shares most bands with, of a component other than its own.

    placed: key, doc, n, c (component). A bucket's head is its smallest doc on
    the first turn and another at each later one; its own component is tried
    against the first doc of the others.
    """
    order = F.col("doc") if turn == 0 else F.xxhash64("doc", F.lit(turn))
    rows = placed.select("key", "doc", "n", "c", order.alias("o"))
    first = scratch.cut(rows.groupBy("key").agg(F.min(F.struct("o", "doc", "n", "c")).alias("h")).select("key", "h"), "op5-heads")
    others = rows.join(first, "key").filter(F.col("c") != F.col("h.c"))
    # Grouped by another form of the key, so that the rows of a large bucket, which the
    # join has dealt by the key itself, are reduced where they are before they meet.
    second = others.groupBy(F.bitwise_not("key").alias("yek")).agg(F.min(F.struct("o", "doc", "n", "c")).alias("h"))
    second = scratch.cut(second.select(F.bitwise_not("yek").alias("key"), "h"), "op5-heads")
    to_second = rows.join(first.select("key", F.col("h.c").alias("c")), ["key", "c"]).join(second, "key")
    tried = others.select("doc", "n", "h").unionByName(to_second.select("doc", "n", "h")).select("doc", "n", F.col("h.doc").alias("head"), F.col("h.n").alias("head_n"))
    shared = tried.filter(sizes_allow("n", "head_n", percent)).groupBy("doc", "head").agg(F.count("*").alias("times"))
    best = shared.groupBy("doc").agg(F.max(F.struct("times", F.xxhash64("head", F.lit(turn)).alias("o"), "head")).alias("x")).select("doc", "x.head")
    pairs = scratch.cut(best.select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")).distinct(), "op5-pairs", first)
    scratch.drop(id(second))
    return pairs


def _open_keys(placed: DataFrame) -> DataFrame:
    """key, main: the buckets that hold classes of several components (c), and the largest of these there."""
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    return sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("m", "c")).alias("x")).filter("k > 1").select("key", F.col("x.c").alias("main"))


def _still_open(met: DataFrame, whole: DataFrame, scratch: Scratch) -> DataFrame:
    """met with each class's component, in the buckets that hold several, and main, the largest of them there."""
    placed = met.join(whole.withColumnRenamed("v", "doc"), "doc", "left").select(*met.columns, F.coalesce("component", "doc").alias("c"))
    keys = scratch.cut(_open_keys(placed), "op5-open")
    return scratch.cut(placed.join(keys, "key"), "op5-placed", keys)


def slices_for(pairs: int, n_classes: int) -> int:
    """A power of two: so many slices that the first has about PAIRS_PER_CLASS pairs for each class."""
    return 1 << max(0, math.ceil(math.log2(max(1, pairs / max(1, PAIRS_PER_CLASS * n_classes)))))


def _unlike(placed: DataFrame) -> DataFrame:
    """placed without the buckets whose classes are exactly those of another: the same pairs meet there."""
    held = placed.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    return placed.join(held.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _by_class(placed: DataFrame, reps: DataFrame, slices: int, scratch: Scratch) -> DataFrame:
    """A row for each class of placed: doc, n, e, keys (its buckets, at most one for each band), cells, s (its slice, by hash)."""
    own = placed.groupBy("doc").agg(F.first("n").alias("n"), F.first("e").alias("e"), F.collect_set("key").alias("keys"))
    return scratch.cut(own.join(reps.select("doc", "cells"), "doc").withColumn("s", F.pmod(F.xxhash64("doc"), F.lit(slices))), "op5-open-classes")


def _across(own: DataFrame, whole: DataFrame, percent: int, slices: int, done: int, upto: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and that no bound rules out, whose slice is from done up to, not including, upto.

    A pair is in the earlier slice of its two classes, whichever way round it stands.
    own: a row for each class, so that what is known of it joins it once, and not once in each bucket.
    """
    classes = own.filter(F.col("s") >= done).join(whole.withColumnRenamed("v", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
    spots = scratch.cut(classes.select("*", F.explode("keys").alias("key")), "op5-spots")
    left, right = (spots.select("key", *(F.col(x).alias(f"{side}{x}") for x in ("doc", "n", "e", "c", "keys", "cells", "s"))) for side in "pq")
    # A pair that shares several buckets comes from the first of them only.
    pair = (F.col("pc") != F.col("qc")) & known_allow("pn", "pe", "qn", "qe", percent) & (F.array_min(F.array_intersect("pkeys", "qkeys")) == F.col("key")) & cells_allow("pn", "pcells", "qn", "qcells", percent)
    # One of the two is not of the bucket's largest component.
    left, here = left.join(scratch.cut(_open_keys(spots), "op5-open"), "key").filter("pc <> main"), lambda c: F.col(c) < upto
    found = left.join(right.filter(here("qs")), "key").filter(pair)
    if upto < slices:
        found = found.unionByName(left.filter(here("ps")).join(right.filter(F.col("qs") >= upto), "key").filter(pair))
    return found.select(F.least("pdoc", "qdoc").alias("a"), F.greatest("pdoc", "qdoc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; percent: the similarity that links."""
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs, percent, scratch)


def _near_duplicates(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    found = scratch.cut(features(docs, math.prod(banding(percent))), "op5-features")
    first = found.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "cells")).alias("x"))
    reps = scratch.cut(first.select(F.monotonically_increasing_id().alias("doc"), "digest", "x.*"), "op5-classes")
    found = scratch.cut(found.select("doc_id", "n_shingles", "digest"), "op5-rows", found)

    crowded = scratch.cut(bands(reps, percent).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"), "op5-crowded")
    met = scratch.cut(bands(reps, percent).join(crowded, "key"), "op5-met", crowded)  # only buckets where classes meet
    placed, whole, turn, before = met.withColumn("c", F.col("doc")), None, 0, None
    n_classes = reps.count()
    while True:
        pairs = stars(placed, turn, percent, scratch)
        new = verified(pairs, reps, docs, percent, scratch)
        scratch.drop(id(pairs))
        if whole is None:
            whole = components(new, scratch)
        else:
            scratch.drop(id(placed))
            whole = joined_up(whole, new, scratch)
        scratch.drop(id(new))
        placed = _still_open(met, whole, scratch)
        rest = placed.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("c") != F.col("main")).alias("m")).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        turn += 1
        if rest <= PAIRS_PER_CLASS * n_classes or (before is not None and 2 * rest > before):
            break
        before = rest
    scratch.drop(id(met))
    left, sets = _unlike(placed).withColumn("e", F.col("n")), None
    if rest > PAIRS_PER_CLASS * n_classes:
        # Many pairs are left: documents with too many shingles of their own can't link with any.
        sets = scratch.cut(sets_of(docs, reps, placed.select("doc").distinct()), "op5-sets")
        left = left.join(shared_sizes(sets), "doc", "left").withColumn("e", F.col("n") - F.coalesce("u", F.lit(0))).filter(known_allow("n", "e", "e", "e", percent)).drop("u")
    # Where many pairs are left, they come in slices, so that a class that finds its component early is spared the others.
    slices, done = slices_for(rest, n_classes), 0
    own = _by_class(left, reps, slices, scratch)
    while True:
        upto = min(slices, max(1, WIDER * done))
        more = verified(_across(own, whole, percent, slices, done, upto, scratch), reps, docs, percent, scratch, sets)
        if not more.isEmpty():
            whole = joined_up(whole, more, scratch)
        done = upto
        if done == slices:
            break
    named = reps.join(whole.withColumnRenamed("v", "doc"), "doc", "left").select("digest", "doc_id", F.coalesce("component", "doc").alias("component"))
    # Every class knows its smallest document, so a component does.
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.select("digest", "component").join(smallest, "component").select("digest", "component_id")
    out = found.join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return cut(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "op5-result")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs by shared shingles, then reachability; for small inputs.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS k FROM w),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, k - 3)) AS i FROM n WHERE k >= 5)
    UNION ALL
    SELECT doc_id, array_to_string(ws, ' ') AS sh FROM n WHERE k BETWEEN 1 AND 4)),
c AS (SELECT doc_id, count(*) AS z FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.z + y.z - p.both)),
r(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(c.z, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN m ON m.v = d.doc_id
"""
