"""Helpers shared by the training-data operators.

Words are runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``), which is what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.scratch import file_system, temporary

U64 = np.uint64
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Ids up to this many (tens of MB) may be broadcast after counting; beyond it the join shuffles.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = temporary(spark, name)
    # Batches of whole texts are what a Python worker's memory goes into. The size
    # is read when a plan with Python in it is made: this one's, and none that
    # another thread makes meanwhile, as each session has its own settings.
    batch = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(batch), BATCH_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, batch)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts lineage, outlives lost executors.

    The folder goes when the application ends.
    """
    return _write(df, name)[0]


def tasks_for(spark: SparkSession, lots: int) -> int:
    """Partitions for so many lots (buckets, shards): as many, up to a few for each core; a task then takes several lots, one after the other."""
    return max(1, min(lots, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))


class Scratch:
    """Tables in the shared folder that one computation needs: they go when it ends, or when others take their place."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*self.paths)

    def cut(self, df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
        """As cut(); the table instead_of, which may be read by df, is not needed any more."""
        out, path = _write(df, name)
        self.paths[id(out)] = (out, path)  # holds out, so that its id stays its own
        if instead_of is not None:
            self.drop(id(instead_of))
        return out

    def drop(self, *keys: int) -> None:
        for key in keys:
            files, hadoop = file_system(self.spark, self.paths.pop(key)[1])
            files.delete(hadoop, True)


SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
BLOCK = 4 << 20


def word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of a long one in several lists."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > BLOCK and (space := SPACE.search(raw, at + BLOCK)):
            end = space.start()
        yield (raw[at:end] if end - at < len(raw) else raw).split()
        at = end


class WordHashes(dict):
    """64-bit hash of a word (bytes); remembers words up to a bound, then starts anew."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of n consecutive entries of h, put together from runs of powers of two."""
    if len(h) < n:
        return np.empty(0, U64)
    power = lambda k: U64(pow(base, k, 1 << 64))
    out, size, part, width = None, 0, h, 1
    while True:
        if n & width:
            m = len(h) - width - size + 1
            out = part if out is None else part[:m] * power(size) + out[width : width + m]
            size += width
        if size == n:
            return out
        part = part[:-width] * power(width) + part[width:]
        width *= 2


def as_bytes(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def held_out() -> "F.Column":
    """crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
