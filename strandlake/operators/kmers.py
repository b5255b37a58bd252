"""K-mers: explosion, counts, and the seed table.

A sequence is tiled before its k-mers are exploded, so that no row carries, and
no substring scans, more than ``TILE`` bases. Where only numbers of k-mers are
wanted, for joins over whole collections, they come from arrays instead: that
was measured at a fifth of the time of strings, their reversal and conversion.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions.dna import kmer_hash, revcomp

TILE = 256
#: Rows handed on at once.
ROWS = 500_000
#: Places of k-mers up to this length are ranked by arrays with a number for each k-mer, in slices of so many.
DENSE, SLICE = 10, 1 << 14
#: K-mers that are counted at once.
COUNTED = 4_000_000
#: Places that a task packs at once, and about so many of a collection that meet in a lot.
LOT = 2_000_000
_VALUES = np.full(256, -1, np.int8)
_VALUES[list(b"ACGT")] = range(4)


def codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all k-mers as they read on either strand: the sum of value(base i) * 4**i, or -1 with unknown bases."""
    v = _VALUES[np.frombuffer(seq.encode(), np.uint8)].astype(np.int64)
    n = len(v) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2
    unknown = np.concatenate([[0], np.cumsum(v < 0)])
    clean = unknown[k:] == unknown[:-k]
    forward, backward, size = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    here, there, width = v, 3 - v, 1  # of runs of width bases
    while size < k:
        if k & width:
            m = len(v) - width - size + 1
            # The longer run begins with the one of this width.
            forward, backward = (here[:m], there[:m]) if not size else (here[:m] + (forward[width : width + m] << (2 * width)), (there[:m] << (2 * size)) + backward[width : width + m])
            size += width
        here, there = here[:-width] + (here[width:] << (2 * width)), (there[:-width] << (2 * width)) + there[width:]
        width *= 2
    return np.where(clean, forward, -1), np.where(clean, backward, -1)


def _numbered(seqs: DataFrame, key: str, schema: str, rows: Callable[[str], dict[str, np.ndarray]], residues: str = "residues") -> DataFrame:
    """schema: key and the arrays that rows makes of a sequence, a row for each entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for own, seq in zip(pdf[key].tolist(), pdf[residues].array, strict=True):
                found = rows(seq)
                size = len(next(iter(found.values())))
                held.append(pd.DataFrame({key: np.full(size, own), **found}))
                n += size
                if n >= ROWS:
                    yield pd.concat(held)
                    held, n = [], 0
        if held:
            yield pd.concat(held)

    return seqs.select(key, residues).mapInPandas(run, schema)


def _type_of(seqs: DataFrame, key: str) -> str:
    return seqs.schema[key].dataType.simpleString()


def tiles(seqs: DataFrame, k: int, *keep: str, residues: str = "residues", tile: int = TILE) -> DataFrame:
    """keep columns, tile (text), at (its first base): windows that overlap by k - 1."""
    n = F.length(residues)
    long_enough = seqs.filter(n >= k)
    start = F.explode(F.sequence(F.lit(0), n - k, F.lit(tile))).alias("at")
    return long_enough.select(*keep, F.col(residues).alias("_r"), start).select(*keep, F.col("_r").substr(F.col("at") + 1, F.lit(tile + k - 1)).alias("tile"), "at")


def kmers(seqs: DataFrame, k: int, *keep: str, residues: str = "residues", step: int = 1) -> DataFrame:
    """keep columns, kmer, pos for every k-mer of A, C, G, T at a position divisible by step."""
    own = tiles(seqs, k, *keep, residues=residues, tile=TILE - TILE % step)
    spots = own.select(*keep, "tile", "at", F.explode(F.sequence(F.lit(0), F.length("tile") - k, F.lit(step))).alias("i"))
    out = spots.select(*keep, F.col("tile").substr(F.col("i") + 1, F.lit(k)).alias("kmer"), (F.col("at") + F.col("i")).alias("pos"))
    return out.filter(~F.contains("kmer", F.lit("N")))


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n; k up to 31. Counted as numbers, those of many sequences at a time before they are shuffled, and written as text at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def counted() -> pd.DataFrame:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": h, "n": times})

        for pdf in batches:
            for seq in pdf["residues"].dropna():
                h = codes(seq, k)[0]
                held.append(h[h >= 0])
                n += len(held[-1])
                if n >= COUNTED:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    return seqs.select("residues").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).select(word(F.col("h"), k).alias("kmer"), "n")


def word(h: Column, k: int) -> Column:
    """The k-mer of a number that kmer_hash gives."""
    return F.reverse(F.translate(F.lpad(F.conv(h.cast("string"), 10, 4), k, "0"), "0123", "ACGT"))


def _clean(seq: str, k: int, step: int, drop_last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k-mers without unknown bases, and where they are."""
    h = codes(seq[:-1] if drop_last else seq, k)[0][::step]
    at = np.flatnonzero(h >= 0)
    return h[at], (at * step).astype(np.int32)


def seed_places(seqs: DataFrame, k: int, key: str = "seq_id", step: int = 1, drop_last: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
    """h, key, pos: every place of each k-mer, or of those in wanted; drop_last leaves out the last one of each sequence, as some indexes do."""
    sent = None if wanted is None else seqs.sparkSession.sparkContext.broadcast(np.append(np.sort(wanted), -1))  # beyond the last one there is none

    def places(seq: str) -> dict[str, np.ndarray]:
        h, pos = _clean(seq, k, step, drop_last)
        if sent is not None:
            kept = sent.value[np.searchsorted(sent.value[:-1], h)] == h
            h, pos = h[kept], pos[kept]
        return {"h": h, "pos": pos}

    return _numbered(seqs, key, f"{key} {_type_of(seqs, key)}, h long, pos int", places).select("h", key, "pos")


def _bytes_of(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers_of(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


def _stirred(h: np.ndarray, bits: int) -> np.ndarray:
    """A bijection on numbers of so many bits that makes their leading ones even."""
    mask, x = np.uint64((1 << bits) - 1), h.astype(np.uint64)
    x = x * np.uint64(0x9E3779B97F4A7C15) & mask
    x ^= x >> np.uint64(bits // 2)
    return x * np.uint64(0xBF58476D1CE4E5B9) & mask


def first_holders(seqs: DataFrame, k: int) -> DataFrame:
    """a, b, shared, at: each sequence b (seq_id, of 64 bits) with the first one, a, that holds a k-mer of it; shared: over how many distinct ones of b.

    at (pos, pa): the first such k-mer in b, and where it is first in a. Every place of every k-mer counts, but
    places travel packed: those of many sequences are sorted, and dealt in lots by their k-mers' leading bits, in a few bytes each.
    """
    bits, own = 2 * k, seqs.filter("seq_id is not null").select("seq_id", "residues")
    bases = own.agg(F.coalesce(F.sum(F.length("residues")), F.lit(0))).first()[0]
    low = np.uint64(bits - min(bits - 1, max(0, bases // LOT).bit_length()))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, n = [], [], 0

        def lots() -> pd.DataFrame:
            x = np.concatenate([h for h, _ in held])
            owner = np.repeat(np.arange(len(held)), [len(h) for h, _ in held])
            pos = np.concatenate([at for _, at in held])
            order = np.argsort(x, kind="stable")  # of equal k-mers those of a sequence stay together, the first ahead
            x, owner, pos = x[order], owner[order], pos[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])]
            x, owner, pos = x[new], owner[new], pos[new]
            lot = (x >> low).astype(np.int64)
            first = np.flatnonzero(np.diff(lot, prepend=-1))
            rows, known = [], np.array(ids, np.int64)
            for i, j in zip(first, [*first[1:], len(x)], strict=True):
                there, own = np.unique(owner[i:j], return_inverse=True)
                rows.append((lot[i], j - i, _bytes_of(np.diff(x[i:j], prepend=x[i])), int(x[i]), known[there].tobytes(), _bytes_of(own), _bytes_of(pos[i:j])))
            return pd.DataFrame(rows, columns=["lot", "n", "steps", "begin", "ids", "own", "pos"])

        for pdf in batches:
            for seq_id, seq in zip(pdf["seq_id"].tolist(), pdf["residues"].array, strict=True):
                if not isinstance(seq, str):
                    continue
                h, at = _clean(seq, k, 1, False)
                if len(h):
                    ids.append(seq_id)
                    held.append((_stirred(h, bits), at))
                    n += len(h)
                if n >= LOT:
                    yield lots()
                    ids, held, n = [], [], 0
        if held:
            yield lots()

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.cumsum(_numbers_of(r.steps, r.n)) + np.uint64(r.begin), np.frombuffer(r.ids, np.int64)[_numbers_of(r.own, r.n).astype(np.int64)], _numbers_of(r.pos, r.n).astype(np.int32)) for r in pdf.itertuples()]
        x, seq, pos = (np.concatenate([part[i] for part in parts]) for i in range(3))
        order = np.lexsort((pos, seq, x))
        x, seq, pos = x[order], seq[order], pos[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (seq[1:] != seq[:-1])]  # an id that stands twice counts once
        x, seq, pos = x[new], seq[new], pos[new]
        first = np.r_[True, x[1:] != x[:-1]]
        head = np.flatnonzero(first)[np.cumsum(first) - 1][~first]
        a, b, pa, pos = seq[head], seq[~first], pos[head], pos[~first]
        order = np.lexsort((pa, pos, b, a))
        a, b, pa, pos = a[order], b[order], pa[order], pos[order]
        begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        return pd.DataFrame({"a": a[begin], "b": b[begin], "shared": np.diff(begin, append=len(a)), "pos": pos[begin], "pa": pa[begin]})

    lots = own.mapInPandas(packed, "lot long, n long, steps binary, begin long, ids binary, own binary, pos binary").repartition("lot")
    pairs = lots.groupBy("lot").applyInPandas(met, "a long, b long, shared long, pos int, pa int")
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min(F.struct("pos", "pa")).alias("at"))


def seed_table(seqs: DataFrame, k: int, most: int, key: str = "seq_id", step: int = 1, drop_last: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """h, key, pos, rn: at most ``most`` places of each k-mer, the first by key and position.

    The limit is part of the index's meaning; Spark applies it in each map task
    before the shuffle as well, so a k-mer that is everywhere stays small.
    wanted, if given, holds the k-mers (h) to look at; others are left out before they are ranked.
    Where all k-mers are few and all are wanted, no place travels.
    """
    if wanted is None and k <= DENSE and _type_of(seqs, key) in ("int", "bigint"):
        return _ranked_by_counts(seqs, k, most, key, step, drop_last)
    places = seed_places(seqs, k, key, step, drop_last)
    if wanted is not None:
        places = places.join(wanted, "h", "left_semi")
    ranked = places.withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy(key, "pos")))
    return ranked.filter(F.col("rn") <= most)


def _ranked_by_counts(seqs: DataFrame, k: int, most: int, key: str, step: int, drop_last: bool) -> DataFrame:
    """seed_table, a range of the key at a time: how many places of each k-mer lie in the ranges before tells the rank of the first one in a range.

    Sequences travel, their places don't; a task holds a number for each k-mer.
    """
    kind, ranges = _type_of(seqs, key), 4 * seqs.sparkSession.sparkContext.defaultParallelism
    bounds = sorted(set(seqs.select(F.col(key).cast("double").alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.001)))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: F.coalesce(F.col(key).cast("double") >= x, F.lit(False)))) if bounds else F.lit(0)
    own = seqs.filter(F.length("residues") >= k).select(at.alias("p"), F.lit(1).alias("o"), F.col(key).isNotNull().alias("known"), F.coalesce(key, F.lit(0).cast(kind)).alias("own"), "residues", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("body"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Places of each k-mer in a range, up to ``most`` of them, in slices."""
        now, n, held = None, np.zeros(4**k, np.int64), []

        def add() -> None:
            if held:
                n[:] += np.bincount(np.concatenate(held), minlength=4**k)
                held.clear()

        def told() -> pd.DataFrame:
            add()
            capped = np.minimum(n, most).astype(np.int32)
            slices = [(now, i // SLICE, part.tobytes()) for i in range(0, 4**k, SLICE) if (part := capped[i : i + SLICE]).any()]
            n[:] = 0
            return pd.DataFrame(slices, columns=["p", "part", "body"])

        size = 0
        for pdf in batches:
            for p, seq in zip(pdf["p"].tolist(), pdf["residues"].array, strict=True):
                if now is not None and p != now:
                    yield told()
                now = p
                held.append(_clean(seq, k, step, drop_last)[0])
                size += len(held[-1])
                if size >= ROWS:
                    add()
                    size = 0
        if now is not None:
            yield told()

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        """The same of all ranges before."""
        pdf = pdf.sort_values("p")
        n = np.stack([np.frombuffer(x, np.int32) for x in pdf["body"]]).astype(np.int64)
        earlier = np.minimum(np.cumsum(n, axis=0) - n, most).astype(np.int32)
        return pd.DataFrame({"p": pdf["p"], "part": pdf["part"], "body": [x.tobytes() for x in earlier]})

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, held, size = None, np.zeros(4**k, np.int64), [], 0

        def rows() -> pd.DataFrame:
            h, pos = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            ids = pd.Series([x[0] for x in held], dtype="Int64").repeat([len(x[1]) for x in held])
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.diff(h, prepend=-1))
            times = np.diff(first, append=len(h))
            rank = n[h] + np.arange(len(h)) - np.repeat(first, times) + 1
            n[h[first]] += times
            kept = rank <= most
            return pd.DataFrame({"h": h[kept], key: ids.array[order[kept]], "pos": pos[order[kept]], "rn": rank[kept].astype(np.int32)})

        for pdf in batches:
            for p, o, known, own_key, seq, part, body in zip(pdf["p"].tolist(), pdf["o"].tolist(), pdf["known"].tolist(), pdf["own"].tolist(), pdf["residues"].array, pdf["part"].array, pdf["body"].array, strict=True):
                if p != now:
                    if held:
                        yield rows()
                    now, held, size = p, [], 0
                    n[:] = 0
                if o == 0:
                    n[int(part) * SLICE : (int(part) + 1) * SLICE] = np.frombuffer(body, np.int32)
                    continue
                h, pos = _clean(seq, k, step, drop_last)
                free = n[h] < most  # a k-mer that has all its places needs no more looking at
                held.append((own_key if known else None, h[free], pos[free]))
                size += len(held[-1][1])
                if size >= ROWS:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    counts = own.select("p", "residues").repartition(ranges, "p").sortWithinPartitions("p").mapInPandas(counted, "p int, part int, body binary")
    told = counts.groupBy("part").applyInPandas(before, "p int, part int, body binary").select("p", F.lit(0).alias("o"), F.lit(False).alias("known"), F.lit(0).cast(kind).alias("own"), F.lit(None).cast("string").alias("residues"), "part", "body")
    placed = own.unionByName(told).repartition(ranges, "p").sortWithinPartitions("p", "o", "known", "own")
    return placed.mapInPandas(ranked, f"h long, {key} {kind}, pos int, rn int")


def hash_of_revcomp(k: int) -> Column:
    return kmer_hash(revcomp("kmer"), k)


def probes(queries: DataFrame, k: int, query_key: str) -> DataFrame:
    """query_key, qpos, h, fwd: the k-mers of queries as they read on either strand."""
    found = kmers(queries, k, query_key)
    forward = found.select(query_key, F.col("pos").alias("qpos"), kmer_hash("kmer", k).alias("h"), F.lit(True).alias("fwd"))
    backward = found.select(query_key, F.col("pos").alias("qpos"), hash_of_revcomp(k).alias("h"), F.lit(False).alias("fwd"))
    return forward.unionByName(backward)


def seed_hits(queries: DataFrame, seeds: DataFrame, k: int, query_key: str, key: str = "seq_id") -> DataFrame:
    """query_key, qpos, key, pos, fwd: places of the seed table that share a k-mer, on either strand."""
    return probes(queries, k, query_key).join(seeds.select("h", key, "pos"), "h").drop("h")


def sampled(seqs: DataFrame, k: int, rate: int, key: str, residues: str = "residues") -> DataFrame:
    """key, h, pos, flipped: one k-mer in ``rate``, chosen by its content and read on its smaller strand.

    Equal stretches of two sequences, on either strand, give equal samples.
    """

    def places(seq: str) -> dict[str, np.ndarray]:
        here, there = codes(seq, k)
        x = spread(np.minimum(here, there).astype(np.uint64))
        at = np.flatnonzero((here >= 0) & (x % np.uint64(rate) == 0))
        return {"h": x[at].view(np.int64), "pos": at.astype(np.int32), "flipped": there[at] < here[at]}

    return _numbered(seqs, key, f"{key} {_type_of(seqs, key)}, h long, pos int, flipped boolean", places, residues)


def spaced_codes(seq: str, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As codes(), of the bases at the given offsets from each position; offsets must read the same from both ends."""
    span, v = offsets[-1] + 1, _VALUES[np.frombuffer(seq.encode(), np.uint8)].astype(np.int64)
    n = len(v) - span + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2
    forward, backward, clean = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for i, at in enumerate(offsets):
        x = v[at : at + n]
        forward += x << (2 * i)
        backward += (3 - x) << (2 * (len(offsets) - 1 - i))
        clean &= x >= 0
    return np.where(clean, forward, -1), np.where(clean, backward, -1)


def spread(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit numbers; different ones stay different."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class SeedPlan:
    """Spaced seeds, all of one weight, of which one in ``rate`` is kept by content; a pair needs ``enough`` of them. miss: computed."""

    patterns: tuple[tuple[int, ...], ...]
    rate: int
    enough: int
    miss: float


def missed(patterns: tuple[tuple[int, ...], ...], rate: int, enough: int, identity: float, length: int, trials: int = 4000) -> float:
    """The share of alignments without gaps, of this length and identity, that fewer than ``enough`` kept seeds hit: by drawing them, always the same ones."""
    draw = np.random.default_rng(1)
    same, hits = draw.random((trials, length)) < identity, np.zeros(trials, np.int64)
    for offsets in patterns:
        n = length - offsets[-1]
        if n > 0:
            met = np.logical_and.reduce([same[:, at : at + n] for at in offsets])
            hits += (met & (draw.random((trials, n)) < 1 / rate)).sum(axis=1)
    return float((hits < enough).mean())


def pattern(weight: int, number: int) -> tuple[int, ...]:
    """The number-th pattern of a weight: ``weight`` offsets within half as many again, ends included, the same from both ends."""
    span = weight + 2 * (weight // 4)
    draw, half = random.Random(1000 * weight + number), list(range(1, span // 2))
    left = sorted([0, *draw.sample(half, weight // 2 - 1)])
    return tuple(left + [span // 2] * (weight % 2) + [span - 1 - x for x in reversed(left)])


@cache
def seed_plan(bases: int, identity: float, length: int, miss: float = 0.05, enough: int = 2) -> SeedPlan:
    """The cheapest seeds that miss a matching stretch of this length and identity with at most this probability.

    Their weight grows with the collection, so that a seed has a sixty-fourth of a chance place in it.
    """
    weight = min(30, max(12, math.ceil(math.log(max(bases, 1), 4)) + 3))
    best = sorted(range(12), key=lambda i: (missed((pattern(weight, i),), 1, 4, identity, length, 400), i))
    for count, rate in ((1, 8), (1, 4), (1, 2), (1, 1), (2, 1), (4, 1), (8, 1)):
        patterns = tuple(pattern(weight, i) for i in best[:count])
        plan = SeedPlan(patterns, rate, enough, missed(patterns, rate, enough, identity, length))
        if plan.miss <= miss:
            break
    return plan


def shared_marks(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left_key, qpos, right_key, pos, fwd: seeds that both have."""
    own = left.select("h", left_key, F.col("pos").alias("qpos"), "flipped")
    return own.join(right.select("h", right_key, "pos", F.col("flipped").alias("turned")), "h").select(left_key, "qpos", right_key, "pos", (F.col("flipped") == F.col("turned")).alias("fwd"))


def first_marks(found: DataFrame, key: str, most: int) -> DataFrame:
    """Of each seed the first ``most`` places by key and position; Spark applies the limit before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy("h").orderBy(key, "pos"))
    return found.withColumn("_rn", rank).filter(F.col("_rn") <= most).drop("_rn")
