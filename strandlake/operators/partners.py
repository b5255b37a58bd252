"""Which texts share seeds on a diagonal, without a row of the shuffle for each seed.

Places of seeds travel packed: those of many texts are sorted, and dealt in lots
by their seeds' leading bits. What a lot finds of pairs of texts, summed by band
of diagonals, is packed and dealt by the first of the two.

``star`` pairs a seed's holders with few of them; it is what first thins out large
groups. ``partners`` is exact: seeds that at most HELD places on the other side
hold make all their pairs; of the others, which are few, every place goes to the
task of each lot. There the pairs known so far are counted to the end, and
then each text looks through the places of its frequent seeds, the rarest first.
As n of a pair is at most the number of seeds that it shares, the seeds that
could not bring a partner up to what is known already need no look: no partner
is lost by that.

Ids are numbers from 0 on that lie densely, so a set of them is a bit for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.kmers import SeedPlan, _bytes_of, _numbers_of, _stirred, first_marks, shared_marks, spaced_codes, spread
from strandlake.scratch import BATCH

Cut = Callable[[DataFrame, str], DataFrame]
#: Diagonals of a band in which seeds are counted.
BAND = 64
#: Seeds with more places than this on the other side are frequent; such are met through FIRST of them to begin with.
HELD, FIRST = 16, 4
#: Places that a task packs at once, and about so many that meet in a lot; places in a row of a lot.
LOT, PART = 1_000_000, 1 << 17
#: Places of frequent seeds that a task holds, and lookups that it makes, at once.
FREQUENT, LOOKUPS = 2_000_000, 4_000_000
#: Rows handed to Python at once where they hold parts of a row of a lot.
SMALLER = 512
#: Ids in a piece of a set.
BITS = 1 << 16
#: Bands are from -LOW on.
LOW = 1 << 20
ROWS = "kind int, lot int, n long, a binary, b binary, c binary, d binary"


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows at most are handed to Python at once, as each is a large one."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def _cut(rows: DataFrame, name: str, cut: Cut, at_once: int = 16) -> DataFrame:
    with few_rows(rows.sparkSession, at_once):
        return cut(rows, name)


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _runs(first: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs that begin at first, in n entries; there may be none."""
    return zip(first, [*first[1:], n][: len(first)], strict=True)


def _places(begin: int, n: int, steps: bytes, ids: bytes, own: bytes, at: bytes, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, id, place) of a packed row; place: twice the position, one more where the seed was read on the other strand."""
    x = np.cumsum(_numbers_of(steps, n)) + np.uint64(begin)
    known = np.cumsum(_numbers_of(ids, m)).astype(np.int64)
    return x.astype(np.int64), known[_numbers_of(own, n).astype(np.int64)], _numbers_of(at, n).astype(np.int64)


def _packed(x: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple:
    known, own = np.unique(ids, return_inverse=True)
    return int(x[0]), len(x), _bytes_of(np.diff(x, prepend=x[0])), _bytes_of(np.diff(known, prepend=0)), _bytes_of(own), _bytes_of(at), len(known)


_FIELDS = "begin long, n long, steps binary, ids binary, own binary, at binary, m long"
_NAMES = [c.split()[0] for c in _FIELDS.split(", ")]


def lots_of(bases: int, plan: SeedPlan) -> int:
    """A power of two."""
    return 1 << (bases * len(plan.patterns) // plan.rate // LOT).bit_length()


def repeated_places(texts: DataFrame, plan: SeedPlan, lots: int, cut: Cut) -> DataFrame:
    """The places of seeds that more than one text (id, residues) holds, packed; seeds are kept by content and read on their smaller strand."""
    weight, rate = len(plan.patterns[0]), np.uint64(plan.rate)
    bits = 2 * weight + (len(plan.patterns) - 1).bit_length()
    low = bits - (lots.bit_length() - 1)

    def seeds_of(seq: str) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for i, offsets in enumerate(plan.patterns):
            here, there = spaced_codes(seq, offsets)
            least = np.minimum(here, there)
            at = np.flatnonzero((here >= 0) & (spread(least.astype(np.uint64) + np.uint64(i << 60)) % rate == 0))
            found.append((_stirred(least[at] + (i << (2 * weight)), bits).astype(np.int64), 2 * at + (there[at] < here[at])))
        return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found, strict=True)))

    def rows(ids: list, held: list) -> pd.DataFrame:
        x, at = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        own = np.repeat(np.array(ids, np.int64), [len(h) for h, _ in held])
        order = np.argsort(x, kind="stable")
        x, own, at = x[order], own[order], at[order]
        lot = x >> low
        first = _begins(lot)
        return pd.DataFrame([(int(lot[i]), *_packed(x[i:j], own[i:j], at[i:j])) for i, j in _runs(first, len(x))], columns=["lot", *_NAMES])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, n = [], [], 0
        for pdf in batches:
            for own, seq in zip(pdf["id"].tolist(), pdf["residues"].array, strict=True):
                x, at = seeds_of(seq)
                if len(x):
                    ids.append(own)
                    held.append((x, at))
                    n += len(x)
                if n >= LOT:
                    yield rows(ids, held)
                    ids, held, n = [], [], 0
        if held:
            yield rows(ids, held)

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_places(*r) for r in pdf[_NAMES].itertuples(index=False)]
        x, ids, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(x, kind="stable")
        x, ids = x[order], ids[order]
        first = _begins(x)
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        kept = np.repeat(several, np.diff(first, append=len(x)))
        x, ids, at = x[kept], ids[kept], at[order][kept]
        order = np.lexsort((at, ids, x))
        x, ids, at = x[order], ids[order], at[order]
        first = _begins(x)  # a seed stays in one row
        ends = first[_begins(first // PART)] if len(first) else first
        return pd.DataFrame([_packed(x[i:j], ids[i:j], at[i:j]) for i, j in _runs(ends, len(x))], columns=_NAMES)

    dealt = texts.mapInPandas(packed, f"lot int, {_FIELDS}").repartition(max(1, min(lots, 4096)), "lot")
    return cut(dealt.groupBy("lot").applyInPandas(repeated, _FIELDS), "chunk-marks")


def members(ids: DataFrame) -> DataFrame:
    """One row, bits: a bit for each id (id) that is in the set."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(BITS, np.uint8)
        held[pdf["id"].to_numpy() % BITS] = 1
        return pd.DataFrame({"part": [key[0]], "body": [np.packbits(held).tobytes()]})

    parts = ids.select("id", F.expr(f"id div {BITS}").alias("part")).groupBy("part").applyInPandas(pack, "part long, body binary")
    return parts.agg(F.collect_list(F.struct("part", "body")).alias("bits"))


def _held(bits, ids: np.ndarray) -> np.ndarray:
    """Whether each id is in the set."""
    out = np.zeros(len(ids), bool)
    part = ids // BITS
    for x in bits:
        there = part == x["part"]
        out[there] = np.unpackbits(np.frombuffer(x["body"], np.uint8))[ids[there] % BITS] == 1
    return out


def _band(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """A number for strand and band of the diagonal of a and b: those of bands that touch differ by one."""
    forward, a, b = (place_a ^ place_b) & 1 == 0, place_a >> 1, place_b >> 1
    return np.where(forward, b - a, b + a) // BAND + LOW + np.where(forward, 2 * LOW, 0)


def _counted(a: np.ndarray, b: np.ndarray, band: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, band, how many places of a): a place counts once in a band."""
    order = np.lexsort((place, band, b, a))
    a, b, band, place = a[order], b[order], band[order], place[order]
    one = _begins(a, b, band, place)
    a, b, band = a[one], b[one], band[one]
    first = _begins(a, b, band)
    return a[first], b[first], band[first], np.diff(first, append=len(a))


def _counted_in_order(pair: np.ndarray, band: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, band, how many places), for numbers of pairs instead of the two ids: all three fit into one number, which is sorted faster."""
    low = int(pair.min()), int(band.min()), int(place.min())
    wide = [int(x.max() - y).bit_length() for x, y in zip((pair, band, place), low, strict=True)]
    if sum(wide) > 62:
        _, *found = _counted(np.zeros_like(pair), pair, band, place)
        return tuple(found)
    x = np.sort(((pair - low[0]) << (wide[1] + wide[2])) | ((band - low[1]) << wide[2]) | (place - low[2]))
    x = x[_begins(x)] >> wide[2]
    first = _begins(x)
    n, x = np.diff(first, append=len(x)), x[first]
    return (x >> wide[1]) + low[0], (x & ((1 << wide[1]) - 1)) + low[1], n


def _lot_of(a: np.ndarray, lots: int) -> np.ndarray:
    return (_stirred(a, 40) % np.uint64(lots)).astype(np.int64)


def _dealt(a: np.ndarray, lots: int, kind: int, *more: np.ndarray) -> pd.DataFrame:
    """ROWS: packed columns, dealt by a; a is ordered within them."""
    lot = _lot_of(a, lots)
    order = np.lexsort((a, lot))
    a, lot, more = a[order], lot[order], [x[order] for x in more]
    first = _begins(lot)
    rows = [(kind, int(lot[i]), j - i, _bytes_of(np.diff(a[i:j], prepend=0)), *(_bytes_of(x[i:j]) for x in more), *([b""] * (3 - len(more)))) for i, j in _runs(first, len(a))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])


def _dealt_pairs(lots: int, a: np.ndarray, b: np.ndarray, band: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    return _dealt(a, lots, 0, b, band, c)


def _undealt(pdf: pd.DataFrame, columns: int) -> list[np.ndarray]:
    rows = [[np.cumsum(_numbers_of(r.a, r.n)).astype(np.int64), *(_numbers_of(x, r.n).astype(np.int64) for x in (r.b, r.c, r.d)[: columns - 1])] for r in pdf.itertuples()]
    return [np.concatenate([np.empty(0, np.int64), *(r[i] for r in rows)]) for i in range(columns)]


def _most(a: np.ndarray, b: np.ndarray, band: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, n): rows summed by pair and band begin a pair at first; n is the most that two bands that touch hold of it. Also the summed a, b, band."""
    order = np.lexsort((band, b, a))
    a, b, band, c = a[order], b[order], band[order], c[order]
    one = _begins(a, b, band)
    c = np.add.reduceat(c, one) if len(one) else c
    a, b, band = a[one], b[one], band[one]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (band[1:] == band[:-1] + 1)
    beside = np.zeros(len(c), np.int64)
    beside[:-1] = np.where(same, c[1:], 0)
    first = _begins(a, b)
    return first, (np.maximum.reduceat(c + beside, first) if len(first) else c), a, b, band, c


def star(places: DataFrame, bits: DataFrame | None, enough: int, lots: int, cut: Cut) -> DataFrame:
    """a, b, n: texts with ``enough`` seeds on a diagonal in common. A seed of HELD places at most pairs all, another its holders with FIRST of its places."""

    some = bits is not None

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x, ids, at = _places(r.begin, r.n, r.steps, r.ids, r.own, r.at, r.m)
                if some:
                    free = _held(r.bits, ids)
                    x, ids, at = x[free], ids[free], at[free]
                first = _begins(x)
                size = np.diff(first, append=len(x))
                end, few = np.repeat(first + size, size), np.repeat(size <= HELD, size)
                own, lo, hi = np.arange(len(x)), [], []
                for d in range(1, HELD):
                    i = own[few & (own + d < end)]
                    lo.append(i)
                    hi.append(i + d)
                begin = np.repeat(first, size)
                for k in range(FIRST):
                    j = own[~few & (own > begin + k)]
                    lo.append(begin[j] + k)
                    hi.append(j)
                i, j = np.concatenate(lo), np.concatenate(hi)
                apart = ids[i] != ids[j]
                i, j = i[apart], j[apart]
                if len(i):
                    yield _dealt_pairs(lots, *_counted(ids[j], ids[i], _band(at[j], at[i]), j))

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        first, n, a, b, *_ = _most(*_undealt(pdf, 4))
        near = n >= enough
        return pd.DataFrame({"a": a[first][near], "b": b[first][near], "n": n[near]})

    from_ = places if bits is None else places.crossJoin(F.broadcast(bits))
    found = from_.mapInPandas(pairs, ROWS).repartition(lots, "lot").groupBy("lot").applyInPandas(edges, "a long, b long, n long")
    return _cut(found, "chunk-edges", cut)


def partners(places: DataFrame, left: DataFrame, right: DataFrame, enough: int, lots: int, cut: Cut, best: bool = True, floors: DataFrame | None = None, join: Callable[..., DataFrame] = shared_marks) -> DataFrame:
    """chunk_id, other, n, bands: of each id of left the one of right that has most of its seeds on a diagonal, of equal ones the smallest.

    left, right: one row each, sets of ids as ``members`` gives them. best=False, for one set
    on both sides: all pairs (other < chunk_id) with ``enough``, and with what floors (id, floor) asks of an id.
    """

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x, ids, at = _places(r.begin, r.n, r.steps, r.ids, r.own, r.at, r.m)
                asks, asked = _held(r.left, ids), _held(r.right, ids)
                first = _begins(x)
                if not len(x):
                    continue
                size = np.diff(first, append=len(x))
                n = np.add.reduceat(asked.astype(np.int64), first)
                here = np.repeat(n, size)
                there = np.flatnonzero(asked)
                begin = np.repeat(np.cumsum(n) - n, size)
                own = np.flatnonzero(asks & (here > 0) & (here <= HELD))
                i, j = [], []
                for k in range(int(here[own].max(initial=0))):
                    some = own[here[own] > k]
                    j.append(some)
                    i.append(there[begin[some] + k])
                if i:
                    i, j = np.concatenate(i), np.concatenate(j)
                    apart = ids[i] != ids[j] if best else ids[i] < ids[j]
                    i, j = i[apart], j[apart]
                    if len(i):
                        yield _dealt_pairs(lots, *_counted(ids[j], ids[i], _band(at[j], at[i]), j))
                often = (here > HELD) & (asks | asked)
                if often.any():
                    yield _dealt(ids[often], lots, 1, x[often], at[often], (asks[often] + 2 * asked[often]).astype(np.int64))

    with_sets = places.crossJoin(F.broadcast(left.withColumnRenamed("bits", "left"))).crossJoin(F.broadcast(right.withColumnRenamed("bits", "right")))
    rows = _cut(with_sets.mapInPandas(met, ROWS), "chunk-met", cut)

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, h, at, side = _undealt(pdf, 4)
            yield pd.DataFrame({"h": h, "chunk_id": ids, "pos": (at >> 1).astype(np.int32), "flipped": at % 2 == 1, "side": side.astype(np.int32)})

    often = rows.filter("kind = 1")
    hot = _cut(often.mapInPandas(one_by_one, "h long, chunk_id long, pos int, flipped boolean, side int"), "chunk-often", cut, SMALLER)
    asking, asked = hot.filter("side % 2 = 1").drop("side"), hot.filter("side >= 2").drop("side")
    few = first_marks(asked, "chunk_id", FIRST).withColumnRenamed("chunk_id", "other")
    known = join(asking, few, "chunk_id", "other").filter("other <> chunk_id" if best else "other < chunk_id").select("chunk_id", "other").distinct()

    def as_rows(kind: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
                    yield _dealt(a, lots, kind, b, np.zeros_like(a), np.zeros_like(a))

        return run

    def asked_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, h, at, side = _undealt(pdf, 4)
            there = side >= 2
            for i in np.unique(ids[there] % blocks):
                own = there & (ids % blocks == i)
                # Ordered by id; the block stands for the lot until rows go to all lots.
                rows_ = _dealt(ids[own], 1, 2, h[own], at[own])
                yield rows_.assign(lot=int(i))

    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // FREQUENT))
    to_all = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wide = to_all(often.mapInPandas(asked_places, ROWS).withColumnRenamed("lot", "block"), "lot", lots)
    more = known.select(F.col("chunk_id").alias("a"), F.col("other").alias("b")).mapInPandas(as_rows(0), ROWS)
    if floors is not None:
        more = more.unionByName(floors.select(F.col("id").alias("a"), F.col("floor").cast("long").alias("b")).mapInPandas(as_rows(3), ROWS))
    every = to_all(rows.unionByName(cut(more, "chunk-known")), "block", blocks).unionByName(wide)

    def nearest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(pdf, key[1], blocks, enough, best)

    schema = "chunk_id long, other long, n long, bands array<struct<fwd:boolean,band:long>>"
    found = every.repartition(min(4096, lots * blocks), "lot", "block").groupBy("lot", "block").applyInPandas(nearest, schema)
    if best and blocks > 1:
        top = found.groupBy("chunk_id").agg(F.max(F.struct("n", (-F.col("other")).alias("t"), "bands")).alias("x"))
        found = top.select("chunk_id", (-F.col("x.t")).alias("other"), "x.n", "x.bands")
    return _cut(found, "chunk-partners", cut, SMALLER)


def _nearest(pdf: pd.DataFrame, block: int, blocks: int, enough: int, best: bool) -> pd.DataFrame:
    kinds = pdf["kind"].to_numpy()
    a, b, band, c = _undealt(pdf[kinds == 0], 4)
    if blocks > 1:
        mine = b % blocks == block
        a, b, band, c = a[mine], b[mine], band[mine], c[mine]
    own, h, at, side = _undealt(pdf[kinds == 1], 4)
    asks = side % 2 == 1
    own, h, at = own[asks], h[asks], at[asks]
    other, oh, oat = _undealt(pdf[kinds == 2], 3)
    asked_for, floor = _undealt(pdf[kinds == 3], 2)

    # Frequent seeds by number; a seed that one text holds twice within a few bands may count twice for a place.
    words, oh = np.unique(oh, return_inverse=True)
    number = np.searchsorted(words, h)
    there = number < len(words)
    there[there] = words[number[there]] == h[there]
    own, h, at = own[there], number[there], at[there]
    order = np.lexsort((at, h, own))
    own, h, at = own[order], h[order], at[order]
    order = np.lexsort((oat >> 1, oat & 1, other, oh))
    oh, other, oat = oh[order], other[order], oat[order]
    posting = np.searchsorted(oh, np.arange(len(words) + 1))
    weight = np.ones(len(words), np.int64)
    twice = (oh[1:] == oh[:-1]) & (other[1:] == other[:-1]) & ((oat[1:] ^ oat[:-1]) & 1 == 0) & ((oat[1:] >> 1) - (oat[:-1] >> 1) < 2 * BAND)
    weight[oh[1:][twice]] = 2
    held, rank = np.unique(other, return_inverse=True)
    key = rank * max(1, len(words)) + oh
    order = np.argsort(key, kind="stable")
    key, key_at = key[order], oat[order]
    texts, start = np.unique(own, return_index=True)
    ends = np.append(start[1:], len(own))

    def frequent(pa: np.ndarray, pb: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(a, b, band, n) of the frequent seeds of pairs."""
        out = []
        if not len(texts) or not len(held):
            return out
        ia, ib = np.searchsorted(texts, pa), np.searchsorted(held, pb)
        there = (ia < len(texts)) & (ib < len(held))
        there[there] = (texts[ia[there]] == pa[there]) & (held[ib[there]] == pb[there])
        pa, pb, ia, ib = pa[there], pb[there], ia[there], ib[there]
        size = ends[ia] - start[ia]
        lot = np.cumsum(size) // LOOKUPS
        for i in _begins(lot):
            j = int(np.searchsorted(lot, lot[i], "right"))
            m = size[i:j]
            pair = np.repeat(np.arange(i, j), m)
            place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + start[ia[pair]]
            want = ib[pair] * len(words) + h[place]
            low = np.searchsorted(key, want)
            n = np.searchsorted(key, want, "right") - low
            hit = np.repeat(np.arange(len(want)), n)
            spot = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + low[hit]
            if len(hit):
                of, band, n = _counted_in_order(pair[hit], _band(at[place[hit]], key_at[spot]), place[hit])
                out.append((pa[of], pb[of], band, n))
        return out

    def joined(parts: list) -> list[np.ndarray]:
        return [np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) for i in range(4)]

    # What the rare seeds say, and how much the frequent ones could add to that.
    first, n, sa, sb, _, sc = _most(a, b, band, c)
    pa, pb = sa[first], sb[first]
    all_of = np.add.reduceat(sc, first) if len(first) else sc
    ids = np.union1d(np.union1d(pa, texts), asked_for)
    at_least, carried = np.full(len(ids), enough), np.zeros(len(ids), np.int64)
    if len(asked_for):
        at_least[np.searchsorted(ids, asked_for)] = np.maximum(enough, floor)
    if len(own):
        carried[np.searchsorted(ids, texts)] = np.add.reduceat(weight[h], start)
    spot = np.searchsorted(ids, pa)
    if best:
        np.maximum.at(at_least, spot, n)
    could = (all_of + carried[spot] >= at_least[spot]) & (carried[spot] > 0)
    extra = frequent(pa[could], pb[could])
    if best and extra:
        f2, n2, a2, b2, *_ = _most(*joined([(a, b, band, c), *extra]))
        np.maximum.at(at_least, np.searchsorted(ids, a2[f2]), n2)
    # Texts whose frequent seeds alone could do as well or better.
    new_a, new_b, size = [], [], 0
    known_begin, known_end = np.searchsorted(pa, texts), np.searchsorted(pa, texts, "right")

    def settle() -> None:
        """Of the pairs collected those that do as well stay."""
        if not new_a:
            return
        f, n, *rows = _most(*joined(frequent(np.concatenate(new_a), np.concatenate(new_b))))
        spot = np.searchsorted(ids, rows[0][f])
        if best:
            np.maximum.at(at_least, spot, n)
        kept = np.repeat(n >= at_least[spot], np.diff(f, append=len(rows[0])))
        extra.append(tuple(x[kept] for x in rows))
        new_a.clear()
        new_b.clear()

    for i, text in enumerate(texts):
        least = at_least[np.searchsorted(ids, text)]
        mine = h[start[i] : ends[i]]
        w = weight[mine]
        if w.sum() < least:
            continue
        length = posting[mine + 1] - posting[mine]
        order = np.argsort(-length, kind="stable")
        looked = np.unique(mine[order[np.cumsum(w[order]) >= least]])
        found = np.unique(np.concatenate([other[posting[x] : posting[x + 1]] for x in looked]))
        found = found[found != text] if best else found[found < text]
        found = found[~np.isin(found, pb[known_begin[i] : known_end[i]])]
        new_a.append(np.full(len(found), text))
        new_b.append(found)
        size += len(found)
        if size > LOOKUPS:
            settle()
            size = 0
    settle()
    first, n, a, b, band, c = _most(*joined([(a, b, band, c), *extra]))
    pa, pb, last = a[first], b[first], np.append(first[1:], len(a))
    near = n >= at_least[np.searchsorted(ids, pa)]
    if best:
        order = np.lexsort((pb, -n, pa))
        near &= np.isin(np.arange(len(pa)), order[_begins(pa[order])])
    rows = []
    for k in np.flatnonzero(near):
        bands = [{"fwd": bool(x >= 2 * LOW), "band": int(x - LOW - (2 * LOW if x >= 2 * LOW else 0))} for x, y in zip(band[first[k] : last[k]].tolist(), c[first[k] : last[k]].tolist(), strict=True) if y]
        rows.append((int(pa[k]), int(pb[k]), int(n[k]), bands))
    return pd.DataFrame(rows, columns=["chunk_id", "other", "n", "bands"])
