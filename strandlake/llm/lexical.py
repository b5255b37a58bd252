"""Ranked lexical search: Block-Max WAND over an index of compressed posting blocks.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, only
A-Z lower-cased. A document's score for a query is an integer sum over the
query's terms, of the term's weight, which falls with the number of documents
that hold it, times its impact in the document, which rises with its
occurrences there and falls with the document's length.

The index is a table of shards: documents that one task read one after the
other, ordered by id. No posting is shuffled. In a shard each term has blocks of
BLOCK postings, compressed by themselves; beside a block stand the last document
in it and the maximum of its impacts. A search moves the pointers of a query's
terms together from one end of a block to the next, on these figures alone: an
interval whose maxima add up to less than the score that is to be beaten is
passed over, and blocks that only such intervals touch are never decompressed.
A term with a single block in the shard is rare there: its postings are intervals
of their own, so its maximum does not count between them.
Intervals of the highest bounds are scored first, all their documents at once.
The score to be beaten is that of the k-th best document of the shard so far, or
of a sixteenth of all shards, which are searched first, whichever is higher: the
k-th best of some documents is never above the k-th best of all.

Nulls and odd rows: null texts, and those without a term, are no documents. Rows
that repeat a doc_id are documents of their own; a null doc_id ranks behind
others of its score. Queries of one id, null among them, are one query of all
their terms, once each; those without a term get no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import BATCH, Scratch, as_bytes, cut, table, word_blocks

#: Bytes of terms as they are compared; all others become blanks.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
BLOCK = 128
#: A shard ends after so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 500_000
#: Shards that a task holds at once.
SHARDS_AT_ONCE = 4
#: Terms of queries that are searched in one pass over the index; more take several.
PASS_TERMS = 200_000
#: An index may be restricted to the terms of queries, if they are so few at most.
VOCABULARY = 1_000_000
#: One shard in so many is searched first.
FIRST = 16

RAW = "shard long, doc_ids array<long>, lengths array<long>, n_terms long, terms array<string>, ends array<int>, places binary, tfs binary"
INDEX = "shard long, doc_ids array<long>, ms array<long>, terms array<string>, ends array<int>, last array<int>, most array<long>, at array<int>, data binary"


def term_blocks(text: object) -> Iterator[list[bytes]]:
    """The terms of a text, those of a long one in several lists."""
    return word_blocks(as_bytes(text).translate(TERM_BYTES))


class Numbers(dict):
    """Numbers terms as they come, or knows those of a vocabulary only."""

    def __init__(self, vocabulary: list[bytes] | None):
        super().__init__({t: i for i, t in enumerate(vocabulary)} if vocabulary is not None else {})
        self.fixed = vocabulary is not None

    def __missing__(self, term: bytes) -> int:
        if self.fixed:
            return -1
        n = self[term] = len(self)
        return n


class Shard:
    """Documents and postings that are being gathered."""

    def __init__(self, vocabulary: list[bytes] | None):
        self.numbers, self.doc_ids, self.lengths, self.postings, self.size = Numbers(vocabulary), [], [], [], 0

    def add(self, doc_id: int | None, text: object) -> None:
        n, found, counts = 0, [], []
        for words in term_blocks(text):
            n += len(words)
            ids, k = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            found.append(ids[ids >= 0])
            counts.append(k[ids >= 0])
        if not n:
            return
        ids, inverse = np.unique(np.concatenate(found), return_inverse=True)
        tf = np.bincount(inverse, np.concatenate(counts), len(ids)).astype(np.int64)
        self.postings.append((ids, np.full(len(ids), len(self.doc_ids)), tf))
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.size += len(ids)

    def row(self, shard: int) -> tuple:
        ids, places, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        order = sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i]))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        places = rank[places]
        by = np.lexsort((places, ids))
        ids, places, tf = ids[by], places[by], tf[by]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        names = list(self.numbers)
        terms = [names[i].decode("utf-8", "replace") for i in ids[first].tolist()]
        ends = [*first[1:].tolist(), len(ids)] if len(first) else []
        lengths = [self.lengths[i] for i in order]
        return shard, [self.doc_ids[i] for i in order], lengths, sum(lengths), terms, ends, places.astype(np.int32).tobytes(), tf.tobytes()


def _raw(vocabulary):
    """The function that makes RAW rows of documents; vocabulary: a broadcast list of terms, or None for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known = None if vocabulary is None else vocabulary.value
        shard, n, names = Shard(known), TaskContext.get().partitionId() << 32, [c.split()[0] for c in RAW.split(", ")]
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                shard.add(None if pd.isna(doc_id) else int(doc_id), text)
                if len(shard.doc_ids) >= SHARD_DOCS or shard.size >= SHARD_POSTINGS:
                    yield pd.DataFrame([shard.row(n)], columns=names)
                    shard, n = Shard(known), n + 1
        if shard.doc_ids:
            yield pd.DataFrame([shard.row(n)], columns=names)

    return run


def packed(places: np.ndarray, tfs: np.ndarray) -> bytes:
    """A block: the widths of its numbers, the gaps between places (the first counts from zero), the occurrences."""
    gaps = np.diff(places, prepend=0)
    kinds = [np.min_scalar_type(int(x.max())) for x in (gaps, tfs)]
    return bytes(k.itemsize for k in kinds) + gaps.astype(kinds[0]).tobytes() + tfs.astype(kinds[1]).tobytes()


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(block) - 2) // (block[0] + block[1])
    gaps = np.frombuffer(block, f"u{block[0]}", n, 2)
    return np.cumsum(gaps.astype(np.int64)), np.frombuffer(block, f"u{block[1]}", n, 2 + n * block[0]).astype(np.int64)


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tfs // (1000 * tfs + 20 * m)


def _sealed(documents: int, words: int):
    """The function that makes INDEX rows of RAW rows, with the figures of the whole collection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                ms = 50 + 50 * np.asarray(r.lengths, np.int64) * documents // words
                places, tfs = np.frombuffer(r.places, np.int32).astype(np.int64), np.frombuffer(r.tfs, np.int64)
                impact, begin = impacts(tfs, ms[places]), 0
                ends, last, most, at, data = [], [], [], [0], []
                for end in r.ends:
                    for lo in range(begin, end, BLOCK):
                        hi = min(lo + BLOCK, end)
                        data.append(packed(places[lo:hi], tfs[lo:hi]))
                        last.append(int(places[hi - 1]))
                        most.append(int(impact[lo:hi].max()))
                        at.append(at[-1] + len(data[-1]))
                    ends.append(len(last))
                    begin = end
                rows.append((r.shard, r.doc_ids, ms, r.terms, ends, last, most, at, b"".join(data)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    return run


class Opened:
    """A shard of the index, whose blocks are decompressed when they are asked for."""

    def __init__(self, r):
        self.doc_ids, self.ms, self.data = r.doc_ids, np.asarray(r.ms, np.int64), r.data
        self.last, self.most, self.at = np.asarray(r.last, np.int64), np.asarray(r.most, np.int64), r.at
        ends = [int(x) for x in r.ends]
        self.blocks_of = dict(zip(r.terms, zip([0, *ends], ends), strict=True))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """places, impacts."""
        if i not in self.open:
            places, tfs = unpacked(self.data[self.at[i] : self.at[i + 1]])
            self.open[i] = places, impacts(tfs, self.ms[places])
        return self.open[i]

    def best(self, query: list[tuple[str, int]], k: int, least: int) -> list[tuple[int, int]]:
        """(place, score) of the k best documents with a score of at least ``least``, best first, ties by place."""
        terms = [(*self.blocks_of[t], w) for t, w in query if w and t in self.blocks_of]
        if not terms:
            return []
        # Terms of one block are rare here: they are opened, and their postings are intervals of their own.
        rare = [(*self.block(a), w) for a, b, w in terms if b - a == 1]
        terms = [x for x in terms if x[1] - x[0] > 1]
        stops = np.unique(np.concatenate([self.last[a:b] for a, b, _ in terms] + [x for spots, _, _ in rare for x in (spots, spots - 1)]))  # the last places of intervals
        within = [np.searchsorted(self.last[a:b], stops) for a, b, _ in terms]  # the block of each term that an interval lies in
        bound = np.zeros(len(stops), np.int64)
        for (a, b, w), x in zip(terms, within, strict=True):
            bound += w * np.append(self.most[a:b], 0)[x]
        for spots, impact, w in rare:
            bound[np.searchsorted(stops, spots)] += w * impact
        left = np.argsort(-bound, kind="stable")
        places, scores, least, width = np.empty(0, np.int64), np.empty(0, np.int64), max(1, least), 8
        while len(left := left[bound[left] >= least]):
            now, left, width = left[:width], left[width:], 2 * width
            total = np.zeros(len(self.doc_ids), np.int64)
            for spots, impact, w in rare:
                total[spots] += w * impact
            for (a, b, w), x in zip(terms, within, strict=True):
                for i in np.unique(x[now]).tolist():
                    if a + i < b:
                        spots, impact = self.block(a + i)
                        total[spots] += w * impact
            found = np.flatnonzero(total >= least)
            found = found[np.isin(np.searchsorted(stops, found), now)]
            places, scores = np.concatenate([places, found]), np.concatenate([scores, total[found]])
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
        return list(zip(places.tolist(), scores.tolist(), strict=True))


class _Batches:
    """Inside, Python gets so many rows at once of plans that are made."""

    def __init__(self, spark: SparkSession, rows: int):
        self.spark, self.rows = spark, rows

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(self.rows))

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(BATCH, self.before)


def query_terms(queries: DataFrame) -> DataFrame:
    """id, term, each once: the terms of queries (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(own, t.decode("utf-8", "replace")) for own, text in zip(pdf["id"].array, pdf["text"].array, strict=True) for words in term_blocks(text) for t in set(words)]
            yield pd.DataFrame([(None if pd.isna(own) else own, t) for own, t in rows], columns=["id", "term"]).astype({"id": "Int64"})

    return queries.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, "id long, term string").distinct()


class BlockMaxIndex:
    """An index over documents (doc_id, text) in tables of a Scratch, or of whatever has its ``cut``."""

    def __init__(self, shards: DataFrame, frequencies: DataFrame, documents: int):
        self.shards, self.frequencies, self.documents = shards, frequencies, documents

    @classmethod
    def build(cls, docs: DataFrame, keep: Scratch, only: DataFrame | None = None) -> BlockMaxIndex:
        """only (term): postings of other terms are left out if there are at most VOCABULARY of these; the figures of the collection count all terms."""
        spark, vocabulary = docs.sparkSession, None
        if only is not None and len(found := only.select("term").distinct().limit(VOCABULARY + 1).collect()) <= VOCABULARY:
            vocabulary = spark.sparkContext.broadcast([r.term.encode() for r in found])
        raw = keep.cut(docs.select("doc_id", "text").mapInPandas(_raw(vocabulary), RAW), "postings")
        size = raw.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("documents"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("words")).first()
        ends = F.col("ends")
        held = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (ends[i] - F.when(i > 0, ends[F.greatest(i - 1, F.lit(0))]).otherwise(0)).alias("df")))
        frequencies = keep.cut(raw.select(F.inline(held)).groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
        with _Batches(spark, SHARDS_AT_ONCE):
            shards = keep.cut(raw.mapInPandas(_sealed(size.documents, max(1, size.words)), INDEX), "shards", raw)
        return cls(shards, frequencies, size.documents)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def _candidates(self, shards: DataFrame, asked: list[tuple], k: int, least: dict) -> DataFrame:
        """id, doc_id, score: the best k of each shard that reach ``least`` (by id)."""
        queries = shards.sparkSession.sparkContext.broadcast((asked, least))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    shard, rows = Opened(r), []
                    for own, query in queries.value[0]:
                        rows += [(own, shard.doc_ids[i], s) for i, s in shard.best(query, k, queries.value[1].get(own, 1))]
                    yield pd.DataFrame(rows, columns=["id", "doc_id", "score"]).astype({"id": "Int64", "doc_id": "Int64", "score": "int64"})

        return shards.mapInPandas(run, "id long, doc_id long, score long")

    def search(self, terms: DataFrame, k: int, keep: Scratch) -> DataFrame:
        """id, rank, doc_id, score: the k best documents of each query, given by its terms (id, term)."""
        spark = self.shards.sparkSession
        terms = keep.cut(terms.join(self.frequencies, "term"), "query-terms")  # terms that no document holds add nothing
        passes = max(1, -(-terms.count() // PASS_TERMS))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        found = []
        for i in range(passes):
            own = terms.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms"))
            asked = [(r.id, [(t.term, self.weight(t.df)) for t in r.terms]) for r in own.collect()]
            with _Batches(spark, SHARDS_AT_ONCE):
                first = keep.cut(self._candidates(self.shards.filter(early), asked, k, {}), "first-found")
                ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
                least = {r.id: r.score for r in ranked.filter(F.col("rank") == k).collect()}
                found += [first, keep.cut(self._candidates(self.shards.filter(~early), asked, k, least), "found")]
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
        return ranked.filter(F.col("rank") <= k).select("id", "rank", "doc_id", "score")


K = 50

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
posting AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY 1),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM doc),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posting, total GROUP BY term, big_n),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT a.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * d.n * t.big_n) // t.big_l)))) AS BIGINT) AS score
  FROM asked a JOIN posting p ON p.term = a.term JOIN weight w ON w.term = a.term JOIN doc d ON d.doc_id = p.doc_id, total t GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 best documents of each benchmark item. The index holds the postings of the items' terms only, as it serves them once."""
    with Scratch(spark) as keep:
        terms = keep.cut(query_terms(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")), "terms")
        index = BlockMaxIndex.build(table(spark, sf_dir, "documents"), keep, terms)
        return cut(index.search(terms, K, keep).select(F.col("id").alias("item_id"), "rank", "doc_id", "score"), "ranked")
