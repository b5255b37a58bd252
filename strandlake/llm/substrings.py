"""Exact removal of repeated 20-word passages by super-k-mer partitioning.

The minimiser of a window is the smallest hash among its 5-word grams. Runs of
consecutive windows with one minimiser travel as one packed string to the
bucket of that minimiser, so equal windows always meet and each word is sent
about three times instead of twenty.

Minimisers are counted before strings travel: five bytes of each, with its
place, go to the bucket, and the places of those that stand twice come back.
Other strings, unless a gram repeats within them, hold no repeated window and
are not sent. What a task sends to a bucket at once is packed together and
compressed, strings of one minimiser side by side. In the bucket the words are
hashed as they come, only hashes of windows are kept, and these are sorted by
128 bits, then by document and start; all but the first of each run are
repeats. The texts are shuffled by document once, for all three passes.

Against hot buckets: grams that many documents of a bounded sample hold are
ranked after all others, so that they are minimisers only of windows that have
no other gram. Which grams are ranked so changes the buckets, not the result,
as long as all tasks agree. And a packed string that a task has already sent
under a smaller document and start is not sent again, all its windows being
repeats: a passage copied into a third of all rows reaches its bucket about
once per task. When minimisers are counted, one that stands often in a chunk of
a task goes to its bucket once, and its other places past it. Buckets are many, tasks a few for
each core: a task sorts its buckets, and holds one at a time.

Defined results: null, empty or white text has no words and hashes the empty
string; texts under 20 words lose nothing; rows with null doc_id are left
whole and others are not compared with them; repeated rows of a doc_id and
text count as one, and each gets the removals found for it; different texts of
a doc_id are told apart by a 64-bit hash of the text, in whose order they come;
very long texts are packed in parts; other columns are ignored by
``remove_repeats`` and kept by ``with_repeats_removed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import U64, WordHashes, as_bytes, cut, mixed, rolling, table, tasks_for, word_blocks

WINDOW, GRAM = 20, 5
#: Grams per window.
SPAN = WINDOW - GRAM + 1
#: Words that a task packs at once, distinct words it remembers, and packed strings it remembers.
CHUNK, VOCABULARY, SEEN = 1_500_000, 200_000, 30_000
#: Bytes of text whose windows go to one bucket, on average, and whose minimisers do.
BUCKET, COUNTING_BUCKET = 16 << 20, 32 << 20
#: Documents looked at for hot grams, the share of them that makes a gram hot, and cells of the table of hot grams.
SAMPLE, HOT, CELLS = 4000, 0.005, 1 << 20
OTHER_BASE = 0xD6E8FEB86659FD93

PACKED = "bucket int, body binary"
PLACES = "doc_id long, version long, start int"
#: Runs of windows of a text: version is the hash of the text.
RUNS = "doc_id long, version long, start long, windows long"
COUNTS = ("n_words", "n_removed", "kept_sha256")


def sliding_min(g: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of span entries, in log2(span) passes; span is a power of two."""
    width = 1
    while width < span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    return g


def ranks(h: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """The order of grams among minimisers: by hash, those in hot cells after all others."""
    g = mixed(rolling(h, GRAM))
    last = U64(0) if hot is None else hot[g >> U64(44)].astype(U64) << U64(63)
    return (g >> U64(1)) | last


def repetitive(h: np.ndarray, hot: np.ndarray | None, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether a gram stands twice within SPAN places of a string: only then can a window repeat within it."""
    g = ranks(h, hot)
    near = np.zeros(len(g), bool)
    for d in range(1, min(SPAN + 1, len(g))):
        near[:-d] |= g[d:] == g[:-d]
    total = np.concatenate([[0], np.cumsum(near)])
    return total[begin + windows + SPAN - 1] > total[begin]


def super_kmers(lens: np.ndarray, h: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(segment, first word, windows, minimiser) of each super-k-mer.

    lens: words of each segment; h: the hashes of all their words in a row.
    """
    least = sliding_min(ranks(h, hot), SPAN)
    segment = np.repeat(np.arange(len(lens)), lens)
    n = len(least)
    if not n:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),)
    inside = segment[:n] == segment[WINDOW - 1 : n + WINDOW - 1]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (segment[1:n] != segment[: n - 1])
    begin = np.flatnonzero(new & inside)
    edges = np.append(np.flatnonzero(new | ~inside), n)
    end = edges[np.searchsorted(edges, begin, side="right")]
    return segment[begin], begin, end - begin, least[begin]


def _planes(a: np.ndarray) -> bytes:
    """The bytes of integers, all first ones, then all second ones: they compress better."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


#: Parts of a body: documents and versions of segments; segment, start and windows of strings; bytes.
PARTS = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)


def to_body(zip_: zstandard.ZstdCompressor, *arrays: np.ndarray) -> bytes:
    parts = [_planes(np.ascontiguousarray(a, k)) for a, k in zip(arrays, PARTS, strict=True)]
    return zip_.compress(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts))


def from_body(unzip: zstandard.ZstdDecompressor, body: bytes) -> list[np.ndarray]:
    raw = unzip.decompress(body)
    edges = np.concatenate([[0], np.cumsum(np.frombuffer(raw[: 8 * len(PARTS)], np.int64))]) + 8 * len(PARTS)
    return [_from_planes(raw[i:j], k) for i, j, k in zip(edges[:-1].tolist(), edges[1:].tolist(), PARTS, strict=True)]


class Packer:
    """Takes texts and makes PACKED rows of them, a chunk at a time: of their minimisers (``counting``), or of
    the strings at given places, where rows without words are repeats found on the spot."""

    def __init__(self, buckets: int, hot: np.ndarray | None, counting: bool):
        self.buckets, self.hot, self.counting = buckets, hot, counting
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.seen: dict[bytes, tuple] = {}
        self.zip = zstandard.ZstdCompressor(level=3)
        self._clear()

    def _clear(self) -> None:
        self.docs, self.versions, self.starts, self.codes, self.texts, self.wanted, self.held = [], [], [], [], [], [], 0
        if len(self.words) > VOCABULARY:
            self.numbers, self.words = {}, []

    def numbered(self, words: list[bytes]) -> np.ndarray:
        numbers, names = self.numbers, self.words
        if new := [w for w in set(words) if w not in numbers]:
            names.extend(new)
            numbers.update(zip(new, range(len(numbers), len(names)), strict=True))
        return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))

    def add(self, doc: int, version: int, text: bytes, places: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        """Packs what is held when it is enough. places: the starts of the strings to send. A long text is cut into segments that overlap by all but one word of a window."""
        at, tail = 0, []  # words before the segment, and the last ones of the segment before
        for words in word_blocks(text):
            words = tail + words
            if len(words) < WINDOW:
                tail = words
                continue
            self.docs.append(doc)
            self.versions.append(version)
            self.starts.append(at)
            self.codes.append(self.numbered(words))
            if not self.counting:
                self.texts.append(b" ".join(words))
                self.wanted.append(places)
            self.held += len(words)
            at, tail = at + len(words) - (WINDOW - 1), words[-(WINDOW - 1) :]
            if self.held >= CHUNK or len(self.words) > 3 * VOCABULARY:
                yield from self.packed()

    def packed(self) -> Iterator[pd.DataFrame]:
        rows = [*self._rows()] if self.codes else []
        self._clear()
        if rows:
            yield pd.DataFrame(rows, columns=["bucket", "body"])

    def _rows(self) -> Iterator[tuple[int, bytes]]:
        codes, lens = np.concatenate(self.codes), np.array([len(c) for c in self.codes])
        docs, versions, starts = np.array(self.docs, np.int64), np.array(self.versions, np.int64), np.array(self.starts, np.int64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), U64, len(self.words))[codes]
        segment, begin, windows, least = super_kmers(lens, h, self.hot)
        if not len(segment):
            return
        start = begin - (np.cumsum(lens) - lens)[segment] + starts[segment]
        if self.counting:
            yield from self._minimisers(docs, versions, segment, start, least, repetitive(h, self.hot, begin, windows))
            return
        wanted = np.concatenate([(k << 32) + np.asarray(x, np.int64) for k, x in enumerate(self.wanted)])
        sent = np.isin((segment << 32) + start, wanted)
        segment, begin, windows, least, start = (x[sent] for x in (segment, begin, windows, least, start))
        size = windows + WINDOW - 1
        bucket = (mixed(least) % U64(self.buckets)).astype(np.int64)
        bucket = self._first_seen(self._names(h, begin, size), bucket, docs[segment], versions[segment], start)
        order = np.lexsort((least, bucket))
        if not len(order):
            return
        text = np.frombuffer(b"\n".join([*self.texts, b""]), np.uint8)
        places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words))[codes] + 1)])
        first, n = places[begin], places[begin + size] - places[begin]
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            b, m = int(bucket[part[0]]), n[part]
            segments, local = np.unique(segment[part], return_inverse=True)
            words = text[:0] if b < 0 else text[np.repeat(first[part] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            yield b if b >= 0 else -1 - b, to_body(self.zip, docs[segments], versions[segments], local, start[part], windows[part], words)

    def _minimisers(self, docs: np.ndarray, versions: np.ndarray, segment: np.ndarray, start: np.ndarray, least: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Five bytes of each minimiser, twice where its string may repeat windows of its own or the chunk has it again.

        Of one that stands again in the chunk only the first goes to its bucket; the other
        places are known to be asked for, and go to any bucket (with windows), which hands them on.
        """
        key = mixed(least)
        _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        head = np.zeros(len(key), bool)
        head[first] = True
        twice, known = twice | again & head, np.flatnonzero(again & ~head)
        if len(known):
            segments, local = np.unique(segment[known], return_inverse=True)
            any_ = int(mixed(key[known[:1]] + U64(len(known)) + docs[segments[:1]].view(U64))[0] % U64(self.buckets))
            yield any_, to_body(self.zip, docs[segments], versions[segments], local, start[known], np.ones(len(known)), np.empty(0, np.uint8))
        bucket = (key % U64(self.buckets)).astype(np.int64)
        order = np.flatnonzero(~again | head)
        order = order[np.argsort(bucket[order], kind="stable")]
        order = np.repeat(order, 1 + twice[order])
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            segments, local = np.unique(segment[part], return_inverse=True)
            yield int(bucket[part[0]]), to_body(self.zip, docs[segments], versions[segments], local, start[part], part[:0], (key[part] >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5].ravel())

    @staticmethod
    def _names(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[bytes]:
        """128 bits for the words of each string, by differences of running sums."""
        out = []
        for base, x in ((0x9E3779B97F4A7C15, h), (OTHER_BASE, mixed(h))):
            up = np.cumprod(np.full(len(h), base, U64))
            down = np.cumprod(np.full(len(h), pow(base, -1, 1 << 64), U64))
            total = np.concatenate([np.zeros(1, U64), np.cumsum(x * up, dtype=U64)])
            out.append(mixed((total[begin + size] - total[begin]) * down[begin] + size.astype(U64)))
        return np.stack(out, axis=1).view("V16").ravel().tolist()

    def _first_seen(self, names: list[bytes], bucket: np.ndarray, docs: np.ndarray, versions: np.ndarray, start: np.ndarray) -> np.ndarray:
        """bucket, as -1 - bucket for strings that stand earlier among those that the task has sent."""
        seen, repeat = self.seen, []
        for k, (name, at) in enumerate(zip(names, zip(docs.tolist(), versions.tolist(), start.tolist(), strict=True), strict=True)):
            if (first := seen.setdefault(name, at)) < at:
                repeat.append(k)
            elif first is not at:
                seen[name] = at
        for name in list(seen)[: max(0, len(seen) - SEEN)]:
            del seen[name]
        bucket[repeat] = -1 - bucket[repeat]
        return bucket


def pack(buckets: int, hot: object, counting: bool):
    """Batches of (doc_id, version, text, and places unless counting) to PACKED rows. hot: a broadcast table of cells, or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(buckets, None if hot is None else hot.value, counting)
        for pdf in batches:
            places = [None] * len(pdf) if counting else pdf["places"]
            for doc_id, version, text, own in zip(pdf["doc_id"].array, pdf["version"].array, pdf["text"].array, places, strict=True):
                yield from packer.add(int(doc_id), int(version), as_bytes(text), own)
        yield from packer.packed()

    return run


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator[list[np.ndarray]]]]:
    """The bodies of each bucket, of rows sorted by bucket."""
    unzip = zstandard.ZstdDecompressor()
    rows = ((b, body) for pdf in batches for b, body in zip(pdf["bucket"].tolist(), pdf["body"].array, strict=True))
    for b, own in groupby(rows, lambda row: row[0]):
        yield b, (from_body(unzip, body) for _, body in own)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PLACES of minimisers that stand twice in their bucket, and places that are known to. What is held grows with chunks, not with copies in a chunk."""
    for _, bodies in _buckets(batches):
        docs, versions, starts, keys = [], [], [], []
        for d, v, local, start, known, raw in bodies:
            if len(known):
                yield pd.DataFrame({"doc_id": d[local], "version": v[local], "start": start})
                continue
            docs.append(d[local]), versions.append(v[local]), starts.append(start)
            key = np.zeros((len(start), 8), np.uint8)
            key[:, :5] = raw.reshape(-1, 5)
            keys.append(key.view(U64).ravel())
        if not keys:
            continue
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        pick = order[again]
        yield pd.DataFrame({"doc_id": np.concatenate(docs)[pick], "version": np.concatenate(versions)[pick], "start": np.concatenate(starts)[pick]})


def hashed(body: list[np.ndarray], hashes: WordHashes) -> tuple[np.ndarray, ...]:
    """(document, version, start, 64 bits, 64 other bits) of each window of a body."""
    docs, versions, local, start, windows, words = body
    h = hashes.array(words.tobytes().split())
    # Strings lie one after the other; a string of w windows has w + 19 words.
    size = windows + WINDOW - 1
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(size) - size, windows) + step
    segment = np.repeat(local, windows)
    return docs[segment], versions[segment], (np.repeat(start, windows) + step).astype(np.int32), rolling(h, WINDOW)[at], rolling(mixed(h), WINDOW, OTHER_BASE)[at]


def repeats(doc: np.ndarray, version: np.ndarray, start: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, version, start) of each window of a bucket whose words start earlier elsewhere in it."""
    order = np.argsort(one, kind="stable")
    same = one[order][1:] == one[order][:-1]
    if not same.any():
        return doc[:0], version[:0], start[:0]
    pick = np.zeros(len(order), bool)
    pick[1:] |= same
    pick[:-1] |= same
    order = order[pick]
    one, two, start, doc, version = one[order], two[order], start[order], doc[order], version[order]
    order = np.lexsort((start, version, doc, two, one))
    one, two, start, doc, version = (x[order] for x in (one, two, start, doc, version))
    head = np.ones(len(order), bool)
    head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    again = ~head
    return doc[again], version[again], start[again]


def intervals(doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Consecutive window starts of a text as RUNS."""
    if not len(doc):
        return pd.DataFrame({"doc_id": doc, "version": version, "start": start, "windows": start})
    order = np.lexsort((start, version, doc))
    doc, version, start = doc[order], version[order], start[order].astype(np.int64)
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1
    return pd.DataFrame({"doc_id": doc[at], "version": version[at], "start": start[at], "windows": start[last] - start[at] + 1})


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """RUNS of windows that stand earlier in their bucket; the hashes of one bucket's windows are held at a time."""
    hashes = WordHashes()
    for _, bodies in _buckets(batches):
        held = []
        for body in bodies:
            if len(body[-1]):
                held.append(hashed(body, hashes))
                continue
            docs, versions, local, start, windows, _ = body
            yield pd.DataFrame({"doc_id": docs[local], "version": versions[local], "start": start, "windows": windows})
        if held:
            yield intervals(*repeats(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _version(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def hot_grams(texts: DataFrame, rows: int) -> np.ndarray | None:
    """The cells of grams that HOT of the documents of a sample or more hold; None if there are none."""
    some = texts.filter(F.pmod(F.col("version"), F.lit(max(1, rows // SAMPLE))) == 0) if rows > SAMPLE else texts

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells of the grams of each document, counted."""
        for pdf in batches:
            n = np.zeros(CELLS, np.int64)
            for text in pdf["text"].array:
                own: set[int] = set()
                for words in word_blocks(as_bytes(text)):
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
                    own.update((mixed(rolling(h, GRAM)) >> U64(44)).tolist())
                n[list(own)] += 1
            at = np.flatnonzero(n)
            yield pd.DataFrame({"cell": at, "n": n[at]})

    counts = some.select("text").mapInPandas(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    least = max(4, int(HOT * min(rows, SAMPLE)))
    found = [r["cell"] for r in counts.filter(F.col("n") >= least).select("cell").collect()]  # CELLS at most
    if not found:
        return None
    hot = np.zeros(CELLS, bool)
    hot[found] = True
    return hot


def _with_runs(docs: DataFrame, how: str) -> DataFrame:
    """doc_id, version, text, runs (flat array of start, windows): each text of a document once; how "inner": those with runs."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version("text").alias("version"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows, size = own.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    hot = hot_grams(own, rows)
    # All three passes have this subtree, so Spark makes its shuffle once.
    texts = own.groupBy("doc_id", "version").agg(F.first("text").alias("text"))
    hot = None if hot is None else spark.sparkContext.broadcast(hot)

    def dealt(df: DataFrame, bytes_: int, counting: bool) -> DataFrame:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // bytes_))
        return df.mapInPandas(pack(buckets, hot, counting), PACKED).repartition(tasks_for(spark, buckets), "bucket").sortWithinPartitions("bucket")

    places = dealt(texts, COUNTING_BUCKET, True).mapInPandas(_count, PLACES)
    asked = places.groupBy("doc_id", "version").agg(F.collect_list("start").alias("places"))
    found = dealt(texts.join(asked, ["doc_id", "version"]), BUCKET, False).mapInPandas(_scan, RUNS)
    runs = found.groupBy("doc_id", "version").agg(F.flatten(F.collect_set(F.array("start", "windows"))).alias("runs"))
    return texts.join(runs, ["doc_id", "version"], how)


def kept_words(text: object, runs: np.ndarray) -> Iterator[tuple[list[bytes], int]]:
    """The words that stay, and how many there were, for each block of a text. runs: rows (start, windows)."""
    at = 0
    for words in word_blocks(as_bytes(text)):
        n = len(words)
        first, last = runs[:, 0] - at, runs[:, 0] + runs[:, 1] + WINDOW - 1 - at
        here = (first < n) & (last > 0)
        if here.any():
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.maximum(first[here], 0), 1)
            np.add.at(edge, np.minimum(last[here], n), -1)
            words = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
        yield words, n
        at += n


def _pairs(runs: object) -> np.ndarray:
    return np.asarray(runs if runs is not None else [], np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, version, text, runs in zip(pdf["doc_id"].array, pdf["version"].array, pdf["text"].array, pdf["runs"], strict=True):
                sha, n, kept = hashlib.sha256(), 0, 0
                for words, of in kept_words(text, _pairs(runs)):
                    if words:
                        sha.update((b" " if kept else b"") + b" ".join(words))
                    n, kept = n + of, kept + len(words)
                rows.append((doc_id, version, n, n - kept, sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "version", *COUNTS]).astype({"doc_id": "Int64"})

    def counted(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "version", "text", "runs").mapInPandas(run, "doc_id long, version long, n_words long, n_removed long, kept_sha256 string")

    counts = cut(counted(_with_runs(docs, "left")), "op7-counts")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version("text").alias("version"), F.col("text").cast("string").alias("text"))
    alone = counted(own.filter("doc_id is null").withColumn("runs", F.lit(None).cast("array<long>")))
    named = own.filter("doc_id is not null").select("doc_id", "version").join(counts, ["doc_id", "version"], "left")
    out = named.unionByName(alone).select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[:2]), F.coalesce(COUNTS[2], F.lit(hashlib.sha256().hexdigest())).alias(COUNTS[2]))
    return out


def with_repeats_removed(docs: DataFrame) -> DataFrame:
    """docs with each text that holds repeats replaced by its kept words, joined by one space."""

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(w for words, _ in kept_words(t, _pairs(r)) for w in words).decode("utf-8", "surrogatepass") for t, r in zip(text, runs, strict=True)], dtype=object)

    changed = cut(_with_runs(docs, "inner").select(F.col("doc_id").alias("_id"), "version", rewrite("text", "runs").alias("new")), "op7-changed")
    # docs may have columns of any name: they travel in one struct.
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), _version("text").alias("version"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = F.col("row")
    return own.join(changed, ["_id", "version"], "left").select(*(F.when(F.col("new").isNull(), row[c]).otherwise(F.col("new")).alias(c) if c == "text" else row[c].alias(c) for c in docs.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every window as a row; for small inputs.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM v) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS t, count(*) AS n
  FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.j = p.j WHERE g.j IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
