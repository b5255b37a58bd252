"""Catalogues a collection before it is compressed: what it is made of, and how much of it is there twice.

    python -m jobs.catalogue_sequences SEQUENCES OUT [--config FILE]

For each sequence: length, unknown bases, G and C, a digest that is the same for
its reverse complement, the first sequence of that digest and how many have it,
and how many of its chunks, and of their bases, an earlier sequence holds on
either strand. Written to OUT/length_class=short|medium|long; the whole folder is
replaced, so a run that broke off is run again, and every run over the same
table gives the same rows.

Null texts are sequences of length 0. Rows with a null id are left out and
logged. Rows that repeat an id are catalogued each, but their chunks are counted
together, and none is earlier than the other.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.shared import Watch, configured, residues, session
from strandlake.functions.dna import revcomp


@dataclass(frozen=True)
class Config:
    id: str = "doc_id"
    text: str = "text"
    label: str = "source"
    encoding: str = "text"
    chunk: int = 1000
    short: int = 300  # shorter ones are too short for a match
    long: int = 10_000  # from here on a sequence is more than one chunk of the compression


ENTRY = "seq_id long, label string, length int, unknown int, gc int, digest string, first_seq long, copies long, chunks long, repeated_chunks long, repeated_bases long, length_class string"


def either_strand(seq: Column) -> Column:
    return F.sha2(F.least(seq, revcomp(seq)), 256)


def entries(seqs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """seqs (seq_id, label, residues) with the columns of ENTRY, and what they are made from, which Spark keeps on disk until it is told otherwise.

    Each sequence is looked at once: digests of it and of its chunks are kept, so that
    groupings, joins and what Spark filters before those don't make them again.
    """
    n, r = F.length("residues"), F.col("residues")
    without = lambda bases: reduce(lambda x, base: F.replace(x, F.lit(base), F.lit("")), bases, r)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / config.chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    piece = lambda i: r.substr(i * config.chunk + 1, F.lit(config.chunk))
    looked = seqs.select(
        "seq_id", "label", n.alias("length"), (n - F.length(without("N"))).alias("unknown"), (n - F.length(without("GC"))).alias("gc"), either_strand(r).alias("digest"),
        F.transform(starts, lambda i: F.struct(F.length(piece(i)).alias("size"), either_strand(piece(i)).alias("key"))).alias("pieces"),
    ).persist(StorageLevel.DISK_ONLY)
    own = looked.drop("pieces")
    # Counts are made before rows travel; only digests that stand more than once are joined back.
    same = own.groupBy("digest").agg(F.min("seq_id").alias("first_seq"), F.count("*").alias("copies")).filter("copies > 1")
    held = looked.select("seq_id", F.inline("pieces")).groupBy("seq_id", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bases"))
    first = held.groupBy("key").agg(F.min("seq_id").alias("holder"), F.max("seq_id").alias("last")).filter("holder < last").select("key", "holder")
    earlier = F.col("holder") < F.col("seq_id")
    shared = held.join(first, "key", "left").groupBy("seq_id").agg(F.sum("n").alias("chunks"), F.sum(F.when(earlier, F.col("n")).otherwise(0)).alias("repeated_chunks"), F.sum(F.when(earlier, F.col("bases")).otherwise(0)).alias("repeated_bases"))
    met = own.join(same, "digest", "left").join(shared, "seq_id", "left")
    length_class = F.when(F.col("length") < config.short, "short").when(F.col("length") < config.long, "medium").otherwise("long")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "repeated_chunks", "repeated_bases")]
    return met.select("seq_id", "label", "length", "unknown", "gc", "digest", F.coalesce("first_seq", "seq_id").alias("first_seq"), F.coalesce("copies", F.lit(1)).alias("copies"), *counts, length_class.alias("length_class")), looked


def run(spark: SparkSession, sequences: str, out: str, config: Config | None = None) -> dict:
    config, watch = config or Config(), Watch()
    rows = spark.read.parquet(sequences)
    # Dealt before they become bases, as a file of few row groups is read by few tasks.
    own = rows.filter(F.col(config.id).isNotNull()).select(config.id, config.label, config.text).repartition(config.id)
    found, looked = entries(own.select(F.col(config.id).cast("long").alias("seq_id"), F.col(config.label).cast("string").alias("label"), residues(config.text, config.encoding).alias("residues")), config)
    try:
        found.write.mode("overwrite").partitionBy("length_class").parquet(out)
    finally:
        looked.unpersist()
    read = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(config.id).isNull()).alias("without_id")).first().asDict()
    written = catalogue(spark, out).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("length", "bases"), ("repeated_bases", "repeated_bases")))).first().asDict()
    watch.tell(f"read {sequences}", **read)
    watch.tell(f"wrote {out}", **written)
    return {"read": read, "written": written}


def catalogue(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(out)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("sequences")
    args.add_argument("out")
    args.add_argument("--config", help="a JSON file, like catalogue_sequences.json")
    given = args.parse_args()
    spark = session("catalogue_sequences")
    try:
        run(spark, given.sequences, given.out, configured(Config, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
