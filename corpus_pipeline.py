"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import quality
from strandlake.llm.common import cut, table
from strandlake.llm.minhash import near_duplicates
from strandlake.llm.packing import pack_documents
from strandlake.llm.secret_ledger import redacted
from strandlake.llm.substrings import with_repeats_removed

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score lower are rejected.
LEAST_QUALITY = 0.5
#: Percentage of common shingles that makes documents near copies.
LINKED = 80


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on these documents and their labels, does not reject."""
    scores = quality.scored(docs, table(spark, sf_dir, "labels"), *(c for c in DOCUMENT if c != "doc_id"))
    return scores.filter(F.col("score") >= LEAST_QUALITY).select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies; rows without a doc_id, and those of a doc_id with a text that is first, all stay."""
    gone = near_duplicates(docs, LINKED).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that also occur earlier out of the texts."""
    return _measured(with_repeats_removed(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    return _measured(redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece of a document."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the hash functions and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
