"""Best-fit packing of tokenised documents by large-item matching.

A document's tokens end with one separator. Documents longer than a sequence
are cut into whole sequences, the remainder first. What is left is packed in
shards of about ``SHARD`` pieces, each in one task over a few numbers per piece:
pieces above a third of a sequence are matched greedily, largest first with the
largest partner that fits, at most two to a bin; smaller pieces then go, largest
first, where they leave the smallest gap, and open new bins only when nothing
fits. Token ids stay where they were computed: pieces carry their checksum.

Defined results: null text is empty and becomes the separator alone; repeated
rows and rows with null doc_id are packed like any other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import cut, table, tasks_for

CAPACITY, SEPARATOR = 1024, 2
#: Pieces that one task packs; the loss at a shard's end is a fraction of a bin.
SHARD = 16_384
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids as the tokenizers library gives them.

    The tiktoken form of the same vocabulary is several times faster and is used
    for texts of Latin letters, digits and common punctuation without special
    tokens, on which both agree; every other text goes through tokenizers.
    """

    LATIN = "ɏ"

    def __init__(self, path: str):
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow, self.fast = Tokenizer.from_file(path), None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or "<|" in text or max(text, default="") > self.LATIN:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """PIECE rows of every document, with the ids themselves if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                ids = np.array([*(encode(text) if isinstance(text, str) and text else ()), SEPARATOR], "<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + n]
                    rows.append((doc_id, k, start, n, zlib.crc32(own.tobytes()), *([own.tolist()] if with_ids else ())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else ())]).astype({"doc_id": "Int64"})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, PIECE + (", ids array<long>" if with_ids else ""))


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, by large-item matching and best fit."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    open_gaps, count = 0, 0  # bit g: some bin has g free

    def fit(least: int) -> int:
        """The smallest free space of at least ``least``, or -1."""
        rest = open_gaps >> least
        return least + (rest & -rest).bit_length() - 1 if rest else -1

    def put(k: int, gap: int) -> None:
        nonlocal open_gaps, count
        if gap < 0:
            b, gap, count = count, capacity, count + 1
        else:
            b = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
        bins[k], offsets[k] = b, capacity - gap
        if left := gap - size[k]:
            gaps[left].append(b)
            open_gaps |= 1 << left

    large = [k for k in order if 3 * size[k] > capacity]
    by_size: dict[int, list[int]] = {}
    sizes = 0  # bit s: some unmatched large piece has s tokens
    for k in large:
        by_size.setdefault(size[k], []).append(k)
        sizes |= 1 << size[k]

    def take(s: int) -> int:
        nonlocal sizes
        k = by_size[s].pop()
        if not by_size[s]:
            sizes &= ~(1 << s)
        return k

    while sizes:
        k = take(sizes.bit_length() - 1)
        put(k, -1)
        room = capacity - size[k]
        if partner := (sizes & ((1 << (room + 1)) - 1)).bit_length():
            put(take(partner - 1), room)
    for k in order[len(large) :]:
        put(k, fit(size[k]))
    return bins, offsets


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (PIECE columns at least, a written table) with sequence_id and offset."""
    shards = max(1, math.ceil(found.count() / SHARD))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = pack(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    schema = found.schema.add("sequence_id", "long").add("offset", "long")
    # Rows are dealt by their place in the table found, not by an id that many of them may share.
    place = F.xxhash64(F.monotonically_increasing_id())
    # By range, so that tasks get the same number of shards; a task packs one after the other.
    return found.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).repartitionByRange(tasks_for(found.sparkSession, shards), "shard").groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return packed(cut(pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity), "op2-pieces"), capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids."""
    ids = pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity, with_ids=True)
    placed = packed(cut(ids, "op2-pieces"), capacity)
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
