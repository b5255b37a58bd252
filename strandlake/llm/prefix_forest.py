"""Approximate nearest neighbours by inner product: a forest of hash-prefix trees.

A tree is a sorted array of long hash strings, here ``BITS`` sign bits of random
projections per vector. A query descends to its longest prefix match in every
tree by binary search and then ascends all trees at once, a bit at a time: first
until the ranges under its shortened prefix hold two distinct classes for each
neighbour wanted, which are scored exactly. The worst of the neighbours so
found lies at some angle; a vector at that angle shares a prefix of a given
length with the query in none of the trees with a known probability, and the
query ascends further until that is ``MISS`` at most. So a query among close
neighbours stops deep, with few candidates however large the index, and only
one whose neighbours are far, as among vectors without structure, meets much of
it. An index of no more than ``FLOOR`` classes for each neighbour wanted is
met whole. Vectors get one more coordinate that makes their norms equal, which turns
inner product into angle.

Equal vectors form one class, so that a vector held by a third of all rows is
indexed and searched once. The index lies in blocks of about ``BLOCK`` classes,
each with its part of every tree; queries, in chunks, visit all blocks, where
those without a match in a block cost a binary search in each tree, and their
depth is chosen from the counts of all blocks together.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with null vec_id; candidates are the
vectors of the query's length; repeated rows of a vec_id and vector count once;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import U64, Scratch, cut, table

TREES, BITS = 32, 24
#: Classes for each neighbour wanted up to which an index is met whole.
FLOOR = 20
#: Probability to meet none of the ranges that hold a vector as near as the last neighbour found.
MISS = 0.1
BLOCK, CHUNK = 8192, 4096
NEAREST = 20


def usable(v: Column) -> Column:
    inf = float("inf")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0), F.lit(False))


def strings(x: np.ndarray) -> np.ndarray:
    """Hash strings (trees, rows) of augmented vectors, as integers of BITS bits."""
    planes = np.random.default_rng(61).standard_normal((TREES * BITS, x.shape[1]))
    bits = (x @ planes.T > 0).reshape(len(x), TREES, BITS).astype(U64)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=U64)).sum(axis=2, dtype=U64).T


def _augmented(v: np.ndarray, norm: float | None) -> np.ndarray:
    extra = np.zeros(len(v)) if norm is None else np.sqrt(np.maximum(0.0, norm * norm - (v * v).sum(axis=1)))
    return np.hstack([v, extra[:, None]])


def _split(pdf: pd.DataFrame, dim: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    entries, queries = pdf[~pdf["asks"]].sort_values("cid", ignore_index=True), pdf[pdf["asks"]].reset_index(drop=True)
    vectors = [np.array([np.asarray(x, float) for x in part["v"]], float).reshape(len(part), dim) for part in (entries, queries)]
    return entries, queries, *vectors


def _ranges(sorted_: np.ndarray, q: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where entries that share their first ``level`` bits with q begin and end."""
    shift = (BITS - np.asarray(level)).astype(U64)
    low = (q >> shift) << shift
    return np.searchsorted(sorted_, low), np.searchsorted(sorted_, low + (U64(1) << shift))


class Forest:
    """The trees over some vectors, sorted, and ranges under prefixes of queries."""

    def __init__(self, vectors: np.ndarray, norm: float):
        self.vectors = vectors
        hashes = strings(_augmented(vectors, norm))
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.trees = np.take_along_axis(hashes, self.order, axis=1)

    def counts(self, queries: np.ndarray) -> np.ndarray:
        """(queries, levels): the entries of all trees that share so many first bits with a query."""
        found = np.zeros((len(queries), BITS + 1), np.int64)
        for tree, own in zip(self.trees, strings(_augmented(queries, None)), strict=True):
            for level in range(BITS + 1):
                lo, hi = _ranges(tree, own, level)
                found[:, level] += hi - lo
        return found

    def met(self, queries: np.ndarray, level: np.ndarray) -> Iterator[np.ndarray]:
        """The distinct vectors in the ranges of each query."""
        spans = [_ranges(tree, own, level) for tree, own in zip(self.trees, strings(_augmented(queries, None)), strict=True)]
        mark = np.zeros(len(self.vectors), bool)
        for i in range(len(queries)):
            mark[:] = False
            for order, (lo, hi) in zip(self.order, spans, strict=True):
                mark[order[lo[i] : hi[i]]] = True
            yield np.flatnonzero(mark)


def safe_level(score: np.ndarray, query_norm: np.ndarray, norm: float) -> np.ndarray:
    """The deepest level at which a vector of that score is missed by all trees with probability MISS at most."""
    cosine = np.clip(score / np.maximum(query_norm * norm, 1e-300), -1, 1)
    same_bit = np.clip(1 - np.arccos(cosine) / np.pi, 1e-9, 1 - 1e-9)
    return np.clip(np.floor(np.log(1 - MISS ** (1 / TREES)) / np.log(same_bit)), 0, BITS).astype(np.int32)


def first_level(found: np.ndarray, k: int) -> np.ndarray:
    """The deepest level at which all trees together hold enough entries; counts fall with depth, and are of the whole index at level 0."""
    # The fullest tree has a TREES-th of the entries at least; one class is the query's own.
    level = np.maximum(0, (found >= TREES * (2 * k + 1)).sum(axis=-1) - 1)
    return np.where(found[:, 0] <= TREES * (FLOOR * k + 1), 0, level)


def nearest(vectors: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score for each row of vectors (vec_id, embedding) for which asks holds."""
    with Scratch(vectors.sparkSession) as scratch:
        return _nearest(vectors, asks, k, scratch)


def _nearest(vectors: DataFrame, asks: Column, k: int, scratch: Scratch) -> DataFrame:
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # A query needs no more than k + 1 members of any class; the limit applies before the shuffle, too.
    ranked = own.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    classes = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # The number of a class: equal vectors have a smallest id, but different ones may share it.
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("cid"), "v", "ids"), "op4-classes")
    asked = scratch.cut(own.filter("asks").select("vec_id", "v").distinct().join(classes.select("cid", "v"), "v").select(F.col("vec_id").alias("query_id"), "cid"), "op4-asked")
    searched = scratch.cut(classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v"), "op4-searched")
    total, norm = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    norm = math.sqrt(norm or 0.0)
    blocks = max(1, math.ceil(total / BLOCK))

    def spread(queries: DataFrame, n: int) -> DataFrame:
        """Entries and n queries (cid, v, level) of each (dimension, block, chunk)."""
        chunks = max(1, math.ceil(n / CHUNK))
        dim = F.size("v").alias("dim")
        entry = classes.select(dim, F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "cid", "v", "ids", F.lit(0).alias("level"))
        query = queries.select(dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"), "cid", "v", F.array().cast("array<long>").alias("ids"), "level")
        return entry.unionByName(query)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entries, queries, e, q = _split(pdf, int(key[0]))
        found = Forest(e, norm).counts(q) if len(e) and len(q) else np.zeros((len(q), BITS + 1), np.int64)
        return pd.DataFrame({"cid": queries["cid"], "found": pd.Series(list(found), dtype=object)})

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entries, queries, e, q = _split(pdf, int(key[0]))
        out: list[tuple[int, int, float]] = []
        if len(e) and len(q):
            ids = entries["ids"].to_list()
            for cid, x, at in zip(queries["cid"].tolist(), q, Forest(e, norm).met(q, queries["level"].to_numpy()), strict=True):
                score = e[at] @ x
                if len(at) > k + 1:  # every class that ties with the last one stays
                    keep = score >= np.partition(score, -(k + 1))[-(k + 1)]
                    at, score = at[keep], score[keep]
                members = [(-s, int(m)) for s, a in zip(score.tolist(), at.tolist(), strict=True) for m in ids[a]]
                out += [(cid, m, -s) for s, m in sorted(members)[: k + 1]]
        return pd.DataFrame(out, columns=["cid", "vec_id", "score"])

    keys = ("dim", "block", "chunk")

    def lists(queries: DataFrame, n: int) -> DataFrame:
        """cid, near: the k + 1 nearest members that n queries (cid, v, level) meet, best first."""
        hits = spread(queries, n).groupBy(*keys).applyInPandas(search, "cid long, vec_id long, score double")
        best = hits.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
        return best.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))

    @F.pandas_udf("int")
    def deepest(found: pd.Series) -> pd.Series:
        return pd.Series(first_level(np.stack(found.to_list()) if len(found) else np.zeros((0, BITS + 1), np.int64), k).astype(np.int32))

    @F.pandas_udf("int")
    def safe(score: pd.Series, query_norm: pd.Series) -> pd.Series:
        return pd.Series(safe_level(score.to_numpy(), query_norm.to_numpy(), norm))

    n = searched.count()
    counts = spread(searched.withColumn("level", F.lit(0)), n).groupBy(*keys).applyInPandas(count, "cid long, found array<long>")
    summed = counts.groupBy("cid").agg(F.array(*(F.sum(F.get("found", F.lit(i))) for i in range(BITS + 1))).alias("found"))
    queries = scratch.cut(searched.join(summed.select("cid", deepest("found").alias("level")), "cid"), "op4-levels")
    first = scratch.cut(lists(queries, n), "op4-lists")
    # Where fewer than k others were met everything was.
    last = F.when(F.size("near") > k, F.element_at("near", -1)["score"])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    higher = queries.join(first.select("cid", last.alias("score")), "cid").filter("level > 0 and score is not null").withColumn("safe", safe("score", length)).filter("safe < level")
    higher = scratch.cut(higher.select("cid", "v", F.col("safe").alias("level")), "op4-higher")
    if m := higher.count():
        second = scratch.cut(lists(higher, m), "op4-lists")
        first = first.join(second.select("cid"), "cid", "left_anti").unionByName(second)
    own_lists = asked.join(first, "cid").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    out = own_lists.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    return cut(out, "op4-result")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
