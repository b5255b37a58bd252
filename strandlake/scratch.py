"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is not set a local folder is made, if Spark runs in this process only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def forgotten(spark: SparkSession, path: str) -> str:
    """path, which goes when the application ends."""
    files, hadoop = file_system(spark, path)
    files.deleteOnExit(hadoop)
    return path


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    return forgotten(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def scratch(spark: SparkSession, rows: int | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """cut(df, name): writes df into the shared folder and reads it again; cuts lineage, outlives lost executors.

    rows: so many at most are handed to Python at once while df is written, where whole sequences would fill its memory.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        path, batch = temporary(spark, name), spark.conf.get(BATCH)
        if rows is not None:
            spark.conf.set(BATCH, str(min(int(batch), rows)))
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(BATCH, batch)
        return spark.read.schema(df.schema).parquet(path)

    return cut
