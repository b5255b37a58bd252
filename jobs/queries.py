"""The jobs as queries: each runs twice into a new folder under spark.checkpoint.dir, and gives all that is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import catalogue_sequences, screen_sequences
from strandlake.queries import SEQS_SQL, kmers_sql
from strandlake.scratch import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_screen_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, screened for the benchmark passages."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        screen_sequences.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/findings", f"{folder}/marks")
    return screen_sequences.findings(spark, f"{folder}/findings")


def job2_catalogue_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        catalogue_sequences.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/catalogue")
    return catalogue_sequences.catalogue(spark, f"{folder}/catalogue")


QUERIES = {f.__name__: f for f in (job1_screen_sequences, job2_catalogue_sequences)}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_STRAND = "least({0}, reverse(translate({0}, 'ACGT', 'TGCA')))"
ORACLE_SQL = {
    "job1_screen_sequences": "WITH " + SEQS_SQL + kmers_sql(20) + f""",
place AS (SELECT seq_id, {_STRAND.format("kmer")} AS h, min(pos) AS pos FROM clean GROUP BY 1, 2),
passage AS (
  SELECT item_id, regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g'), '{_LETTERS}', '{"ACGT" * 13}'), '[^ACGT]', 'N', 'g') AS residues FROM benchmark),
piece AS (SELECT item_id, substr(residues, CAST(i + 1 AS INTEGER), 20) AS kmer FROM (SELECT item_id, residues, unnest(range(0, length(residues) - 19)) AS i FROM passage WHERE length(residues) >= 20)),
entry AS (SELECT DISTINCT item_id, {_STRAND.format("kmer")} AS h FROM piece WHERE NOT contains(kmer, 'N')),
size AS (SELECT item_id, count(*) AS entry_kmers FROM entry GROUP BY 1),
found AS (SELECT p.seq_id, e.item_id, count(*) AS shared, min(p.pos) AS first_pos FROM place p JOIN entry e ON e.h = p.h GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT f.seq_id, f.item_id AS entry_id, f.shared, s.entry_kmers, f.shared * 1000 // s.entry_kmers AS permille, CAST(f.first_pos AS INTEGER) AS first_pos, f.shared * 1000 // s.entry_kmers >= 500 AS contained,
  1::INTEGER AS batch, d.lang FROM found f JOIN size s ON s.item_id = f.item_id JOIN documents d ON d.doc_id = f.seq_id""",
    "job2_catalogue_sequences": "WITH " + SEQS_SQL + f""",
own AS (SELECT s.seq_id, d.source, s.residues, length(s.residues) AS n, sha256({_STRAND.format("s.residues")}) AS digest FROM seqs s JOIN documents d ON d.doc_id = s.seq_id),
chunk AS (SELECT seq_id, substr(residues, CAST(c * 1000 + 1 AS INTEGER), 1000) AS r FROM (SELECT seq_id, residues, unnest(range(0, (length(residues) + 999) // 1000)) AS c FROM seqs WHERE residues <> '')),
held AS (SELECT seq_id, length(r) AS size, {_STRAND.format("r")} AS key FROM chunk),
owned AS (SELECT *, min(seq_id) OVER (PARTITION BY key) < seq_id AS repeated FROM held),
shared AS (SELECT seq_id, count(*) AS chunks, count(*) FILTER (repeated) AS repeated_chunks, CAST(coalesce(sum(size) FILTER (repeated), 0) AS BIGINT) AS repeated_bases FROM owned GROUP BY 1)
SELECT o.seq_id, o.source AS label, CAST(n AS INTEGER) AS length, CAST(n - length(replace(residues, 'N', '')) AS INTEGER) AS unknown, CAST(n - length(replace(replace(residues, 'G', ''), 'C', '')) AS INTEGER) AS gc,
  digest, min(o.seq_id) OVER (PARTITION BY digest) AS first_seq, count(*) OVER (PARTITION BY digest) AS copies, coalesce(chunks, 0) AS chunks, coalesce(repeated_chunks, 0) AS repeated_chunks, coalesce(repeated_bases, 0) AS repeated_bases,
  CASE WHEN n < 300 THEN 'short' WHEN n < 10000 THEN 'medium' ELSE 'long' END AS length_class
FROM own o LEFT JOIN shared s ON s.seq_id = o.seq_id""",
}
