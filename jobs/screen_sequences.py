"""Screens new sequences for those of a panel: vectors, adapters, contaminants, or test items that must not leak.

    python -m jobs.screen_sequences SEQUENCES PANEL OUT MARKS [--config FILE]

Incremental. MARKS is a table of high-water marks: the run takes the sequences
whose id is above the last mark, writes their findings, and then the new mark.
Ids must therefore rise as sequences arrive; rows with a null id are never
taken. A run without new sequences writes nothing.

Findings are written to OUT/batch=N/<partition column>=..., one row for each
sequence and panel entry that share at least ``min_shared`` distinct k-mers, on
either strand: how many, how many the entry has, thousandths of the entry that are
found, the first place, and whether so many make it contained. A run that broke
off before its mark was written is simply run again: it takes the sequences
above the same mark, and its batch, whose folder it overwrites, has the same number.
Two runs must not share MARKS at the same time.

Rows that repeat an id are one sequence's parts: their k-mers are counted once,
and the smallest value of the partition column stands for them. Panel rows of one
id likewise. Entries and sequences without a known k-mer find nothing.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.shared import Watch, configured, log, residues, session
from strandlake.operators.kmers import sampled
from strandlake.scratch import file_system

MARKS = "batch int, high long"


@dataclass(frozen=True)
class Config:
    id: str = "doc_id"
    text: str = "text"
    partition: str = "lang"
    panel_id: str = "item_id"
    panel_text: str = "text"
    encoding: str = "text"
    k: int = 20  # up to 31
    min_shared: int = 30
    contained_permille: int = 500
    broadcast_kmers: int = 2_000_000  # panels of more k-mers are joined by a shuffle


def last_mark(spark: SparkSession, marks: str) -> tuple[int, int | None]:
    """(number of the last batch, highest id that was taken)."""
    files, path = file_system(spark, marks)
    if not files.exists(path):
        return 0, None
    found = spark.read.schema(MARKS).parquet(marks).agg(F.max("batch").alias("batch"), F.max("high").alias("high")).first()
    return found.batch or 0, found.high


def kmers_of(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """key, h, pos: every k-mer, as a number that is the same on both strands."""
    return sampled(seqs.select(key, "residues"), k, 1, key).select(key, "h", "pos")


def screened(seqs: DataFrame, panel: DataFrame, config: Config) -> DataFrame:
    """seqs (seq_id, part, residues), panel (entry_id, residues): seq_id, entry_id, shared, entry_kmers, permille, first_pos, contained, part.

    Where the panel is broadcast, k-mers of sequences don't travel: only those that it has reach the shuffle.
    """
    known = kmers_of(panel, "entry_id", config.k).select("entry_id", "h").distinct()
    size = known.count()
    small = size <= config.broadcast_kmers
    log.info("panel: %d k-mers, %s", size, "broadcast" if small else "joined by a shuffle")
    met = kmers_of(seqs, "seq_id", config.k).join(F.broadcast(known) if small else known, "h")
    each = met.groupBy("seq_id", "entry_id", "h").agg(F.min("pos").alias("pos"))
    found = each.groupBy("seq_id", "entry_id").agg(F.count("*").alias("shared"), F.min("pos").alias("first_pos")).filter(F.col("shared") >= config.min_shared)
    sizes = known.groupBy("entry_id").agg(F.count("*").alias("entry_kmers"))
    permille = F.expr("shared * 1000 div entry_kmers")
    out = found.join(sizes, "entry_id").withColumn("permille", permille).withColumn("contained", F.col("permille") >= config.contained_permille)
    parts = seqs.groupBy("seq_id").agg(F.min("part").alias("part"))  # reads two columns
    return out.join(parts, "seq_id").select("seq_id", "entry_id", "shared", "entry_kmers", "permille", "first_pos", "contained", "part")


def run(spark: SparkSession, sequences: str, panel: str, out: str, marks: str, config: Config | None = None) -> dict:
    """One increment; gives what it read and wrote."""
    config, watch = config or Config(), Watch()
    batch, high = last_mark(spark, marks)
    rows = spark.read.parquet(sequences)
    fresh = rows.filter(F.col(config.id).isNotNull() if high is None else F.col(config.id) > high)
    top, n = fresh.agg(F.max(config.id), F.count("*")).first()  # reads the ids only
    if top is None:
        log.info("nothing above id %s in %s", high, sequences)
        return {"batch": None, "read": 0, "written": 0}
    # What arrives while the job runs is left to the next one.
    fresh, path = fresh.filter(F.col(config.id) <= top), f"{out}/batch={batch + 1}"
    watch.tell(f"reading {sequences}", n)
    seqs = fresh.select(F.col(config.id).cast("long").alias("seq_id"), F.col(config.partition).cast("string").alias("part"), residues(config.text, config.encoding).alias("residues"))
    entries = spark.read.parquet(panel).select(F.col(config.panel_id).cast("long").alias("entry_id"), residues(config.panel_text, config.encoding).alias("residues"))
    found = screened(seqs, entries, config).withColumnRenamed("part", config.partition)
    found.write.mode("overwrite").partitionBy(config.partition).parquet(path)
    written = spark.read.schema(found.schema).parquet(path).count()
    watch.tell(f"read {sequences}", n)
    watch.tell(f"wrote {path}", written)
    spark.createDataFrame([(batch + 1, int(top))], MARKS).coalesce(1).write.mode("append").parquet(marks)
    log.info("batch %d reaches up to id %d", batch + 1, top)
    return {"batch": batch + 1, "read": n, "written": written}


def findings(spark: SparkSession, out: str, config: Config | None = None) -> DataFrame:
    """All findings so far, with the number of their batch."""
    partition = (config or Config()).partition
    return spark.read.schema(f"seq_id long, entry_id long, shared long, entry_kmers long, permille long, first_pos int, contained boolean, batch int, {partition} string").parquet(out)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("sequences", "panel", "out", "marks"):
        args.add_argument(name)
    args.add_argument("--config", help="a JSON file, like screen_sequences.json")
    given = args.parse_args()
    spark = session("screen_sequences")
    try:
        run(spark, given.sequences, given.panel, given.out, given.marks, configured(Config, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
