"""Compression: representative (coarse) pieces, and links with edit scripts to them.

``batch`` is the scalable form. Sequences are cut into chunks; equal chunks
collapse. Spaced seeds, chosen so that a matching stretch of the stated length
and identity is missed with a known, small probability, make chunks candidates
where two or more lie on a diagonal. In rounds, chunks that come before all their
undecided neighbours, those with most in common with neighbours first, become
representatives, until every other one with neighbours is next to one. Edges for
that come from stars first, in which a frequent seed pairs its holders with few
of them; those that are left are compared with all that are left. Then each other
chunk is aligned, from seeds of the size asked for, against the representative, or
the coarse piece of an existing database, that it shares most with, of all there
are (see ``partners``). Every long enough match that is accepted, one after the
other, becomes a link; what matches leave over becomes coarse pieces of its own.
Nothing depends on the order of execution.

``serial`` covers one sequence after the other in one task, each against all
coarse pieces before it, first match first: for small inputs and tests.

Either way the links of a sequence, in order, cover it completely. Ids of
sequences are any 64-bit numbers; coarse pieces get dense numbers, which go on
from those that are there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Generator, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.config import CompressOptions
from strandlake.functions.edits import apply_script, reverse_complement, script_of
from strandlake.operators.align import Match, Squares, match_at, together
from strandlake.operators.chunks import chunk_windows
from strandlake.operators.kmers import codes, seed_plan, shared_marks
from strandlake.operators.partners import BAND, lots_of, members, partners, repeated_places, star
from strandlake.operators.prefix import numbered, running_total

LINKS = "seq_id long, link_no int, coarse_id long, original_start long, original_end long, coarse_start int, coarse_end int, fwd boolean, script string"
COARSE = "coarse_id long, residues string, length int"
PIECES = "chunk_id long, start int, end int, no int, target long, kind int, coarse_start int, coarse_end int, fwd boolean, script string, residues string"
FINE = 4
#: Of the edges of a chunk those count, when representatives are chosen, that have one in WEAK of the strongest one's seeds.
WEAK = 4
#: A stretch that passes every window has somewhat more than the windows' least identity.
ABOVE_WINDOWS = 0.02
#: Chunks of one target that meet in a task.
SHARE = 16
#: A seed on a diagonal that was refused is not tried again within so many bases.
SKIP = 32


def kmer_places(seq: str, k: int) -> dict[str, list[int]]:
    found: dict[str, list[int]] = defaultdict(list)
    for i in range(len(seq) - k + 1):
        if "N" not in (w := seq[i : i + k]):
            found[w].append(i)
    return found


def _along(own: np.ndarray, c: np.ndarray, forward: bool, bands: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(pos, at) of equal k-mers on the diagonals of the bands, one diagonal after the other."""
    found = []
    for d in (band * BAND + i for band in sorted(bands) for i in range(BAND)):
        # at = pos + d, or on the other strand at = d - pos.
        lo, hi = (max(0, -d), min(len(own), len(c) - d)) if forward else (max(0, d - len(c) + 1), min(len(own), d + 1))
        if lo < hi:
            other = c[lo + d : hi + d] if forward else c[d - hi + 1 : d - lo + 1][::-1]
            pos = np.flatnonzero((own[lo:hi] == other) & (other >= 0)) + lo
            found.append((pos, pos + d if forward else d - pos))
    pos, at = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
    order = np.lexsort((at, pos))
    return pos[order], at[order]


def _joined(own: np.ndarray, c: np.ndarray, order: np.ndarray, forward: bool, bands: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same by places of equal k-mers; where they would make more pairs than comparison along the diagonals, by that. order sorts c."""
    ordered = c[order]
    low = np.searchsorted(ordered, own)
    n = np.where(own >= 0, np.searchsorted(ordered, own, "right") - low, 0)
    total = int(n.sum())
    if total > len(bands) * BAND * min(len(own), len(c)):
        return _along(own, c, forward, bands)
    pos = np.repeat(np.arange(len(own)), n)
    at = order[np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)]
    kept = np.isin((at - pos if forward else at + pos) // BAND, list(bands))
    return pos[kept], at[kept]


def _seed_arrays(org: str, coarse: str, k: int, bands: set[tuple[bool, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What seeds gives, as arrays."""
    ways, (c, _) = codes(org, k), codes(coarse, k)
    order = np.argsort(c, kind="stable")
    found = [(*_joined(own, c, order, forward, own_bands), forward) for own, forward in zip(ways, (True, False), strict=True) if (own_bands := {b for f, b in bands if f == forward})]
    pos, at = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
    fwd = np.concatenate([np.empty(0, bool), *(np.full(len(p), forward) for p, _, forward in found)])
    if len(found) > 1:
        both = np.lexsort((at, ~fwd, pos))
        pos, fwd, at = pos[both], fwd[both], at[both]
    return pos, fwd, at


def seeds(org: str, coarse: str, k: int, bands: set[tuple[bool, int]]) -> Generator[tuple[int, bool, int], int | None, None]:
    """(pos in org, whether forward, place in coarse) of equal k-mers in the given bands of diagonals, by pos, forward ones first.

    Sent a pos, it passes over the seeds before that.
    """
    pos, fwd, at = _seed_arrays(org, coarse, k, bands)
    i = 0
    while i < len(pos):
        least = yield int(pos[i]), bool(fwd[i]), int(at[i])
        i = i + 1 if least is None else max(i + 1, int(np.searchsorted(pos, least)))


def _every_seed(org: str, coarse: str, opts: CompressOptions) -> Generator[tuple[int, bool, int], int | None, None]:
    places, k = kmer_places(coarse, opts.map_seed_size), opts.map_seed_size
    for pos in range(len(org) - k + 1):
        word = org[pos : pos + k]
        for forward, key in ((True, word), (False, reverse_complement(word))):
            for at in places.get(key, ())[: opts.max_kmer_freq]:
                yield pos, forward, at


def matches(org: str, coarse: str, opts: CompressOptions, most: int | None = None, bands: set[tuple[bool, int]] | None = None) -> Squares:
    """Gives acceptable matches, at most ``most``, by position in org and without overlap there, forward before
    reverse, from seeds on all diagonals or in some bands; a refused diagonal rests for SKIP bases."""
    if bands is not None:
        return (yield from _matches_in(org, coarse, opts, most, bands))
    found, covered = [], 0
    refused: dict[tuple, int] = {}
    for pos, forward, at in _every_seed(org, coarse, opts):
        diagonal = (forward, (at - pos if forward else at + pos) // 16)
        if pos < covered or pos < refused.get(diagonal, 0):
            continue
        if one := (yield from match_at(coarse, at, org, pos, forward, opts, covered)):
            found.append(one)
            if len(found) == most:
                return found
            covered = one.original_end + 1
        else:
            refused[diagonal] = pos + SKIP
    return found


def _matches_in(org: str, coarse: str, opts: CompressOptions, most: int | None, bands: set[tuple[bool, int]]) -> Squares:
    """The same from seeds in bands, of which most are passed over."""
    pos, fwd, at = _seed_arrays(org, coarse, opts.map_seed_size, bands)
    diagonals = (2 * (np.where(fwd, at - pos, at + pos) // 16) + fwd).tolist()
    pos, fwd, at = pos.tolist(), fwd.tolist(), at.tolist()
    found, covered, i, n = [], 0, 0, len(pos)
    refused: dict[int, int] = {}
    while i < n:
        here, diagonal = pos[i], diagonals[i]
        if here >= refused.get(diagonal, 0):
            if one := (yield from match_at(coarse, at[i], org, here, fwd[i], opts, covered)):
                found.append(one)
                if len(found) == most:
                    return found
                covered = one.original_end + 1
                i = bisect_left(pos, covered, i + 1)
                continue
            refused[diagonal] = here + SKIP
        i += 1
    return found


def first_match(org: str, coarse: str, opts: CompressOptions) -> Match | None:
    return next(iter(next(together([matches(org, coarse, opts, 1)], opts.consec_match_clump_size))), None)


def cover(org: str, found: list[Match], coarse_id: int | None) -> list[tuple]:
    """(start, end exclusive, coarse_id or None, coarse_start, coarse_end, fwd, script): matches, and what they leave over."""
    out, at = [], 0
    literal = lambda start, end: (start, end, None, 0, end - start - 1, True, "")
    for m in found:
        if m.original_start > at:
            out.append(literal(at, m.original_start))
        at = m.original_end + 1
        out.append((m.original_start, at, coarse_id, m.coarse_start, m.coarse_end, m.forward, script_of(m.org, m.coarse)))
    return [*out, literal(at, len(org))] if at < len(org) or not out else out


def pieces_of(org: str, coarse: str, coarse_id: int, opts: CompressOptions) -> list[tuple]:
    return cover(org, next(together([matches(org, coarse, opts)], opts.consec_match_clump_size)), coarse_id)


def heads_of(edges: DataFrame, cut) -> DataFrame:
    """(v, head) for each end of edges (a, b, n): representatives, none of which is another's neighbour, and each other node next to one.

    Rounds of Luby's algorithm. Nodes with most in common with their neighbours,
    in FINE steps for each power of two, come first, others in an order by hash;
    so rounds are logarithmic for each step.
    """
    both = edges.select("a", "b", "n").union(edges.select("b", "a", "n"))
    weight = both.groupBy(F.col("a").alias("v")).agg(F.floor(FINE * F.log2(F.sum("n"))).alias("w"))
    placed = cut(weight.select("v", F.struct((-F.col("w")).alias("w"), F.xxhash64("v").alias("o"), "v").alias("p")), "head-order")
    ends = [placed.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
    left = cut(both.select("a", "b").join(ends[0], "a").join(ends[1], "b"), "head-edges")
    rounds = []
    while True:
        least = left.groupBy(F.col("a").alias("v")).agg(F.first("pa").alias("p"), F.min("pb").alias("least"))
        heads = least.filter("p < least").select("v")
        covered = left.join(heads.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        now = cut(heads.select("v", F.lit(True).alias("head")).unionByName(covered.select("v", F.lit(False).alias("head"))), "decided")
        rounds.append(now)
        gone = now.select("v")
        left = cut(left.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti"), "head-edges")
        if left.isEmpty():
            break
    decided = reduce(DataFrame.unionByName, rounds)
    # A node all of whose neighbours were covered is its own head.
    alone = placed.select("v").join(decided.select("v"), "v", "left_anti").select("v", F.lit(True).alias("head"))
    return decided.unionByName(alone)


def strong(edges: DataFrame) -> DataFrame:
    """edges (a, b, n) without those that are weak beside the strongest of either end: a chunk isn't covered by a chance neighbour while it has a near copy."""
    most = edges.select(F.col("a").alias("v"), "n").union(edges.select("b", "n")).groupBy("v").agg(F.max("n").alias("most"))
    ends = [most.select(F.col("v").alias(c), F.col("most").alias(f"most_{c}")) for c in "ab"]
    return edges.join(ends[0], "a").join(ends[1], "b").filter(F.col("n") * WEAK >= F.greatest("most_a", "most_b")).select("a", "b", "n")


def representatives(free: DataFrame, edges: DataFrame, nearest: Callable[..., DataFrame], cut) -> tuple[DataFrame, DataFrame]:
    """(representatives, others) of free (id): no two of them are near, unless both have a neighbour that is WEAK times as near.

    Edges (a, b, n), which need not be all, thin out large groups; what they leave
    is compared with all that is left.
    """
    covered = cut(heads_of(strong(edges), cut).filter("not head").select(F.col("v").alias("id")), "covered")
    left = cut(free.join(covered, "id", "left_anti"), "chunk-free")
    most = cut(edges.select(F.col("a").alias("id"), "n").union(edges.select("b", "n")).groupBy("id").agg(F.max("n").alias("most")).join(left, "id", "left_semi"), "strongest")
    near = nearest(left, left, best=False, floors=most.select("id", F.ceil(F.col("most") / WEAK).alias("floor"))).select(F.col("chunk_id").alias("a"), F.col("other").alias("b"), "n")
    ends = [most.select(F.col("id").alias(c), F.col("most").alias(f"most_{c}")) for c in "ab"]
    known = F.greatest(F.coalesce("most_a", F.lit(0)), F.coalesce("most_b", F.lit(0)))
    near = cut(near.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(F.col("n") * WEAK >= known).select("a", "b", "n"), "head-near")
    if not near.isEmpty():
        more = heads_of(strong(near), cut).filter("not head").select(F.col("v").alias("id"))
        left = cut(left.join(more, "id", "left_anti"), "chunk-free")
    return left, cut(free.join(left, "id", "left_anti"), "covered")


class Partnered(NamedTuple):
    """Chunks (seq_id, chunk_no, start, end, key), ids of keys, distinct texts (chunk_id, residues), which target each is to be aligned against (best), known pieces, the first new id."""

    chunks: DataFrame
    ids: DataFrame
    distinct: DataFrame
    best: DataFrame
    known: DataFrame | None
    first: int


def batch(seqs: DataFrame, opts: CompressOptions, cut, coarse: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, new coarse pieces) of seqs (seq_id, residues, normalised). cut(df, name) writes df and reads it again."""
    return linked(partnered(seqs, opts, cut, coarse), opts, cut)


def partnered(seqs: DataFrame, opts: CompressOptions, cut, coarse: DataFrame | None = None) -> Partnered:
    """What is aligned against what: the same whatever the size of seeds for alignment."""
    known = coarse if coarse is None else coarse.select("coarse_id", "residues")
    first, before = (0, 0) if known is None else known.agg(F.coalesce(F.max("coarse_id") + 1, F.lit(0)), F.coalesce(F.sum(F.length("residues")), F.lit(0))).first()
    windows = chunk_windows(seqs, opts.max_chunk_size, opts.overlap).withColumn("key", F.sha2("residues", 256))
    chunks = cut(windows.drop("residues"), "chunks")
    # Numbers of chunks go on from those of known pieces, so that both are ids of one kind.
    ids = cut(numbered(chunks.select("key").distinct(), "key", "chunk_id", first, cut), "chunk-ids")
    distinct = cut(windows.select("key", "residues").dropDuplicates(["key"]).join(ids, "key").select("chunk_id", "residues"), "distinct-chunks")

    bases = before + distinct.agg(F.coalesce(F.sum(F.length("residues")), F.lit(0))).first()[0]
    plan = seed_plan(1 << max(1, bases - 1).bit_length(), min(0.99, opts.window_ident_thresh / 100 + ABOVE_WINDOWS), opts.min_match_len)
    texts = distinct.select(F.col("chunk_id").alias("id"), "residues")
    if known is not None:
        texts = texts.unionByName(known.select(F.col("coarse_id").alias("id"), "residues"))
    lots = lots_of(bases, plan)
    places = repeated_places(texts, plan, lots, cut)
    lots = max(1, lots // 4)  # of pairs
    nearest = lambda left, right, **more: partners(places, cut(members(left), "chunk-set"), cut(members(right), "chunk-set"), plan.enough, lots, cut, join=shared_marks, **more)

    free, best = ids.select(F.col("chunk_id").alias("id")), None
    if known is not None:
        # Chunks near the database go to it; only whole chunks can be representatives.
        best = nearest(free, known.select(F.col("coarse_id").alias("id")))
        free = cut(free.join(best.select(F.col("chunk_id").alias("id")), "id", "left_anti"), "chunk-free")
    edges = star(places, None if known is None else cut(members(free), "chunk-set"), plan.enough, lots, cut)
    heads, covered = representatives(free, edges, nearest, cut)
    found = nearest(covered, heads)
    lost = covered.join(found.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    if not lost.isEmpty():
        # Those whose representative was covered itself look for others among each other.
        more, _ = representatives(cut(lost, "chunk-free"), edges.limit(0), nearest, cut)
        heads = cut(heads.unionByName(more), "heads")
        covered = cut(covered.join(more, "id", "left_anti"), "chunk-free")
        found = nearest(covered, heads)
    best = found if best is None else best.unionByName(found)
    best = best.select("chunk_id", F.col("other").alias("target"), F.when(F.col("other") < first, 0).otherwise(1).alias("kind"), "bands")
    return Partnered(chunks, ids, distinct, best, known, first)


def linked(found: Partnered, opts: CompressOptions, cut) -> tuple[DataFrame, DataFrame]:
    """(links, new coarse pieces) of chunks and their targets."""
    chunks, ids, distinct, best, known, first = found
    own = distinct.join(best.select(F.col("target").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("target"), F.col("residues").alias("target_residues"))
    if known is not None:
        own = own.unionByName(known.select(F.col("coarse_id").alias("target"), F.col("residues").alias("target_residues")))
    # The text of a target goes once to each SHARE of its chunks. The number of partitions is stated, so that Spark keeps to it: rows take long for their size.
    shares = cut(best.groupBy("target").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "chunk-shares")
    tasks = 2 * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = distinct.join(best.join(shares, "target").withColumn("share", F.pmod(F.xxhash64("chunk_id"), F.col("shares")).cast("int")).drop("shares"), "chunk_id")
    sent = own.join(shares, "target").select("target", "target_residues", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    paired = parts.repartition(tasks, "target", "share").join(sent.repartition(tasks, "target", "share"), ["target", "share"])
    # What has no partner is a piece as it is.
    alone = distinct.join(best.select("chunk_id"), "chunk_id", "left_anti").select(
        "chunk_id", F.lit(0).alias("start"), F.length("residues").alias("end"), F.lit(0).alias("no"), *(F.lit(None).cast(t).alias(c) for c, t in (("target", "long"), ("kind", "int"))),
        F.lit(0).alias("coarse_start"), (F.length("residues") - 1).alias("coarse_end"), F.lit(True).alias("fwd"), F.lit("").alias("script"), "residues",
    )

    def around(bands: list) -> set[tuple[bool, int]]:
        """The bands and those beside them."""
        return {(bool(x["fwd"]), int(x["band"]) + d) for x in bands for d in (-1, 0, 1)}

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            tasks = (matches(r.residues, r.target_residues, opts, None, around(r.bands)) for r in pdf.itertuples())
            for r, found in zip(pdf.itertuples(), together(tasks, opts.consec_match_clump_size, 500), strict=True):
                target, kind = int(r.target), int(r.kind)
                literals = 0
                for start, end, linked, *rest in cover(r.residues, found, target):
                    if linked is None:
                        rows.append((r.chunk_id, start, end, literals, None, None, *rest, r.residues[start:end]))
                        literals += 1
                    else:
                        rows.append((r.chunk_id, start, end, None, target, kind, *rest, None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.astype({"no": "Int32", "target": "Int64", "kind": "Int32"})

    paired = paired.select("chunk_id", "residues", "target", "kind", "bands", "target_residues")
    pieces = cut(paired.mapInPandas(align, PIECES).unionByName(alone), "pieces")
    # The literal pieces of a chunk are numbered after those of all chunks before it.
    literal = pieces.filter("residues is not null")
    begin = cut(running_total(literal.groupBy("chunk_id").agg(F.count("*").alias("_n")), "chunk_id", F.col("_n"), "begin", cut).select(F.col("chunk_id").alias("owner"), (F.col("begin") + first).alias("begin")), "piece-ids")
    new = literal.select(F.col("chunk_id").alias("owner"), "no", "residues", (F.col("end") - F.col("start")).alias("length")).join(begin, "owner").select((F.col("begin") + F.col("no")).alias("coarse_id"), "residues", "length")
    # A representative is whole, so it is the first literal piece of its chunk.
    owner = F.when(F.col("target").isNull(), F.col("chunk_id")).when(F.col("kind") == 1, F.col("target"))
    coarse_id = F.when(F.col("kind") == 0, F.col("target")).otherwise(F.col("begin") + F.coalesce("no", F.lit(0)))
    placed = pieces.drop("residues").withColumn("owner", owner).join(begin, "owner", "left").withColumn("coarse_id", coarse_id)
    named = chunks.select("seq_id", F.col("start").alias("at"), "key", "chunk_no").join(ids, "key")
    spots = named.join(placed, "chunk_id").select("seq_id", (F.col("at") + F.col("start")).cast("long").alias("original_start"), (F.col("at") + F.col("end") - 1).cast("long").alias("original_end"), "coarse_id", "coarse_start", "coarse_end", "fwd", "script", "chunk_no")
    number = F.row_number().over(Window.partitionBy("seq_id").orderBy("chunk_no", "original_start")) - 1
    links = spots.withColumn("link_no", number.cast("int")).select(*(c.split()[0] for c in LINKS.split(", ")))
    return cut(links, "links"), new


def serial(seqs: DataFrame, opts: CompressOptions, cut, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same by one greedy scan in one task, coarse pieces numbered from first."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        coarse: list[str] = []
        rows = []

        def add(text: str) -> int:
            coarse.append(text)
            for word, at in kmer_places(text, opts.map_seed_size).items():
                index[word] += [(len(coarse) - 1, i) for i in at[: max(0, opts.max_kmer_freq - len(index[word]))]]
            return len(coarse) - 1

        def literal(seq_id: int, org: str, start: int, end: int) -> None:
            rows.append((seq_id, start, end - 1, add(org[start:end]), 0, end - start - 1, True, "", org[start:end]))

        for seq_id, org in pdf.sort_values("seq_id")[["seq_id", "residues"]].itertuples(index=False):
            covered, pos, k = 0, 0, opts.map_seed_size
            refused: dict[tuple, int] = {}
            before = len(coarse)
            while pos + k <= len(org):
                word, found = org[pos : pos + k], None
                for forward, key_ in ((True, word), (False, reverse_complement(word))):
                    for c, at in index.get(key_, ()):
                        diagonal = (c, forward, (at - pos if forward else at + pos) // 16)
                        if c >= before or pos < refused.get(diagonal, 0):  # a sequence does not match itself
                            continue
                        found = next(together([match_at(coarse[c], at, org, pos, forward, opts, covered, min(len(org), covered + 2 * opts.max_chunk_size))], opts.consec_match_clump_size))
                        if found:
                            break
                        refused[diagonal] = pos + SKIP
                    if found:
                        break
                if found:
                    if found.original_start > covered:
                        literal(seq_id, org, covered, found.original_start)
                    rows.append((seq_id, found.original_start, found.original_end, c, found.coarse_start, found.coarse_end, found.forward, script_of(found.org, found.coarse), None))
                    covered = pos = found.original_end + 1
                    refused.clear()
                elif pos - covered >= opts.max_chunk_size:
                    literal(seq_id, org, covered, pos)
                    covered = pos
                    refused.clear()
                else:
                    pos += 1
            if covered < len(org):
                literal(seq_id, org, covered, len(org))
        return pd.DataFrame(rows, columns=["seq_id", "original_start", "original_end", "coarse_id", "coarse_start", "coarse_end", "fwd", "script", "residues"])

    schema = "seq_id long, original_start long, original_end long, coarse_id long, coarse_start int, coarse_end int, fwd boolean, script string, residues string"
    found = cut(seqs.filter(F.length("residues") > 0).select("seq_id", "residues", F.lit(0).alias("g")).groupBy("g").applyInPandas(lambda key, pdf: run(key, pdf), schema), "serial")
    found = found.withColumn("coarse_id", F.col("coarse_id") + first)
    number = F.row_number().over(Window.partitionBy("seq_id").orderBy("original_start")) - 1
    links = found.withColumn("link_no", number.cast("int")).select(*(c.split()[0] for c in LINKS.split(", ")))
    return links, found.filter("residues is not null").select("coarse_id", "residues", F.length("residues").alias("length"))


def decompress(links: DataFrame, coarse: DataFrame) -> DataFrame:
    """seq_id, residues: every sequence rebuilt from its links."""
    piece = apply_script(F.col("script"), F.col("residues").substr(F.col("coarse_start") + 1, F.col("coarse_end") - F.col("coarse_start") + 1), F.col("fwd"))
    pieces = links.join(coarse.select("coarse_id", "residues"), "coarse_id").select("seq_id", "link_no", "original_start", "original_end", piece.alias("piece"))
    earlier = Window.partitionBy("seq_id").orderBy("link_no").rowsBetween(Window.unboundedPreceding, -1)
    skip = F.greatest(F.lit(0), F.coalesce(F.max("original_end").over(earlier) + 1, F.lit(0)) - F.col("original_start"))
    fresh = pieces.select("seq_id", "link_no", F.col("piece").substr((skip + 1).cast("int"), F.length("piece")).alias("piece"))
    ordered = F.sort_array(F.collect_list(F.struct("link_no", "piece")))
    return fresh.groupBy("seq_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("residues"))
