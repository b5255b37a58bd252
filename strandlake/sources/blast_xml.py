"""BLAST XML (output format 5) as a table of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HSP = "struct<Hsp_num:int,Hsp_evalue:double,`Hsp_query-from`:int,`Hsp_query-to`:int,`Hsp_hit-from`:int,`Hsp_hit-to`:int,`Hsp_hit-frame`:int>"
_HIT = f"struct<Hit_num:int,Hit_accession:string,Hit_hsps:struct<Hsp:array<{_HSP}>>>"
SCHEMA = f"`Iteration_iter-num` int, Iteration_hits struct<Hit:array<{_HIT}>>"


def flattened(iterations: DataFrame) -> DataFrame:
    """A row for each HSP: 0-based inclusive ends on the hit, low end first whatever the strand."""
    hits = iterations.select((F.col("`Iteration_iter-num`") - 1).alias("query_no"), F.explode("Iteration_hits.Hit").alias("h"))
    hsps = hits.select("query_no", F.col("h.Hit_num").alias("hit_num"), F.col("h.Hit_accession").cast("bigint").alias("coarse_id"), F.explode("h.Hit_hsps.Hsp").alias("p"))
    low, high = strand_ends(F.col("p.`Hsp_hit-from`"), F.col("p.`Hsp_hit-to`"), F.col("p.`Hsp_hit-frame`"))
    return hsps.select("query_no", "hit_num", "coarse_id", F.col("p.Hsp_num").alias("hsp_num"), F.col("p.Hsp_evalue").alias("evalue"), F.col("p.`Hsp_query-from`").alias("query_from"), F.col("p.`Hsp_query-to`").alias("query_to"), (low - 1).alias("hit_from"), (high - 1).alias("hit_to"), F.col("p.`Hsp_hit-frame`").alias("hit_frame"))


def strand_ends(hit_from, hit_to, frame):
    """The 1-based ends in ascending order: those of the other strand come swapped."""
    return F.when(frame == 1, hit_from).otherwise(hit_to), F.when(frame == 1, hit_to).otherwise(hit_from)


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    return flattened(spark.read.format("xml").option("rowTag", "Iteration").schema(SCHEMA).load(path))


def parse_blast_xml(iterations: DataFrame, column: str = "value") -> DataFrame:
    """The same from one <Iteration> element of text a row."""
    return flattened(iterations.select(F.from_xml(column, SCHEMA).alias("x")).select("x.*"))
