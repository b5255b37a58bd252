"""The functions of this package by name in Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dna import BASES, COMPLEMENT
from strandlake.functions.edits import applied

#: Scalar functions as SQL expressions, so that they stay in the JVM.
SCALAR = {
    "normalised(seq STRING)": ("STRING", f"regexp_replace(translate(seq, 'acgt', '{BASES}'), '[^{BASES}]', 'N')"),
    "revcomp(seq STRING)": ("STRING", f"reverse(translate(seq, '{BASES}', '{COMPLEMENT}'))"),
    "kmer_hash(kmer STRING)": ("BIGINT", f"CASE WHEN translate(kmer, '{BASES}', '') = '' THEN CAST(conv(reverse(translate(kmer, '{BASES}', '0123')), 4, 10) AS BIGINT) ELSE -1 END"),
    "nogap_length(aligned STRING)": ("INT", "length(translate(aligned, '-', ''))"),
}


def register(spark: SparkSession) -> None:
    """Adds normalised, revcomp, kmer_hash, nogap_length, edit_apply(script, coarse, fwd) and the table function kmers(seq, k) -> pos, kmer."""
    for signature, (kind, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS TABLE(pos INT, kmer STRING) RETURN "
        "SELECT i, substring(seq, i + 1, k) FROM (SELECT explode(CASE WHEN length(seq) >= k THEN sequence(0, length(seq) - k) END) AS i)"
    )

    @F.pandas_udf("string")
    def edit_apply(script: pd.Series, coarse: pd.Series, fwd: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or c is None else applied(s, c, bool(f)) for s, c, f in zip(script, coarse, fwd, strict=True)], dtype=object)

    spark.udf.register("edit_apply", edit_apply)
