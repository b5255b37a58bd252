"""Overlapping chunks of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_windows(seqs: DataFrame, size: int, overlap: int) -> DataFrame:
    """seq_id, chunk_no, start, end (exclusive), residues; the last chunk ends with its sequence."""
    n = F.length("residues")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    own = seqs.filter(n > 0).select("seq_id", "residues", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    start = F.col("chunk_no") * step
    end = F.least(start + size, F.length("residues"))
    return own.select("seq_id", "chunk_no", start.alias("start"), end.cast("int").alias("end"), F.col("residues").substr(start + 1, F.lit(size)).alias("residues"))


def dealt(df: DataFrame, *keys: str, times: int = 4) -> DataFrame:
    """df over several tasks for each shuffle partition: for rows that take long for their size, which Spark would put into few tasks."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
