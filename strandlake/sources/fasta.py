"""FASTA: reading, numbering and writing."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.functions.dna import masked
from strandlake.operators.prefix import numbered
from strandlake.scratch import file_system, scratch, temporary

HEADER_TRIM, BODY_TRIM = "> \n\r\t", "* \n\r\t"


def parse_records(texts: DataFrame, column: str = "value", exclude: str = "") -> DataFrame:
    """name, seq and the other columns, from one record of text a row (with or without its '>')."""
    first = F.regexp_extract(column, r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(column, r"^[^\n]*\n?", ""), r"(?m)^[* \r\t]+|[* \r\t]+$|\n", "")
    keep = [c for c in texts.columns if c != column]
    return texts.select(F.btrim(first, F.lit(HEADER_TRIM)).alias("name"), masked(body, exclude).alias("seq"), *keep)


def read_fasta(spark: SparkSession, *paths: str, exclude: str = "") -> DataFrame:
    """seq_id, name, seq of every record of the files, seq_id in the order of paths and records.

    Files are split at record starts, so one file is read by many tasks. The path
    "-" is the driver's standard input, which it copies into the shared folder.
    """
    found = None
    for i, path in enumerate(paths):
        if path == "-":
            path = _copied(spark, sys.stdin)
        part = spark.read.option("lineSep", "\n>").text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.lit(i).alias("arg"))
        found = part if found is None else found.unionByName(part)
    real = found.filter(F.btrim("value", F.lit("> \n\r\t")) != "")
    parsed = parse_records(real, exclude=exclude)
    # Lines are numbered within a task, tasks hold ascending blocks; a rank over
    # the few columns that say where a record lies makes ids dense.
    counts = parsed.groupBy("arg", "file_path", "block").agg(F.count("*").alias("n"))
    order = Window.orderBy("arg", "file_path", "block")
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("arg", "file_path", "block").orderBy("line")
    out = parsed.join(offsets, ["arg", "file_path", "block"]).withColumn("seq_id", F.col("before") + F.row_number().over(within) - 1)
    return out.select(F.col("seq_id").cast("long").alias("seq_id"), "name", "seq")


def _copied(spark: SparkSession, stream: Iterable[str]) -> str:
    """A file in the shared folder with the lines of a stream, written as they come."""
    path = temporary(spark, "stdin")
    files, hadoop = file_system(spark, path)
    out = files.create(hadoop)
    try:
        for line in stream:
            out.write(bytearray(line.encode()))
    finally:
        out.close()
    return path


def read_fasta_stream(spark: SparkSession, folder: str, exclude: str = "") -> DataFrame:
    """name, seq of the records of files as they appear in a folder."""
    texts = spark.readStream.option("lineSep", "\n>").text(folder).filter(F.btrim("value", F.lit(HEADER_TRIM)) != "")
    return parse_records(texts, exclude=exclude)


#: Rows of splits (some 200 bytes each) that may be broadcast after counting; beyond it stretches are shuffled to them.
SPLITS = 100_000
#: A stretch of a record within one split of a file: record, how many headers of the split lie before its bases
#: (0: its header lies in an earlier split); start, its place in the record, or, for record 0, after the bases
#: of the record that earlier splits hold; last, whether the split ends with it.
_STRETCHES = "arg int, file_path string, block long, record long, name string, start long, residues string, last boolean"


def _stretches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Lines of whole splits, in order, as stretches of at most ``size`` bases that start at multiples of it; holds one stretch."""
    split, record, start, name, lines, held = None, 0, 0, None, [], 0
    out: list[tuple] = []

    def close(last: bool = False) -> None:
        nonlocal start, lines, held
        out.append((*split, record, name, start, "".join(lines), last))
        start, lines, held = start + held, [], 0

    for pdf in batches:
        for *where, line in pdf[["arg", "file_path", "block", "value"]].itertuples(index=False):
            if where != split:
                if split is not None:
                    close(last=True)
                split, record, start, name = where, 0, 0, None
            if line.startswith(">"):
                if held or start or record:
                    close()
                record, start, name = record + 1, 0, line.strip(HEADER_TRIM)
                continue
            line = line.strip(BODY_TRIM)
            while held + len(line) > size:
                lines.append(line[: size - held])
                line, held = line[size - held :], size
                close()
            lines.append(line)
            held += len(line)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STRETCHES.split(", ")])
            out = []
    if split is not None:
        close(last=True)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _STRETCHES.split(", ")])


def read_fasta_chunks(spark: SparkSession, *paths: str, size: int = 1 << 20, exclude: str = "") -> DataFrame:
    """seq_id, name, chunk, start, residues: chunks of ``size`` bases, the last one of a record shorter, of records of any length.

    A record is never put together: files are split anywhere, so that a chromosome
    is read by as many tasks as it has splits, and a task holds one chunk.
    Only chunks that a split's end cuts in two travel, and those of
    records that began in an earlier split; how many records and bases lie
    before each split comes from a row for each. Files may be compressed (one
    task each, then, unless the codec splits). Stretches are written into the shared
    folder, so that files are read once. A single line must fit into a row.

    Ids are those of ``read_fasta``, but that every header counts here, even
    one without name and bases. Lines before a file's first header are left out. A record
    without bases has one chunk, an empty one.
    """
    found = None
    for i, path in enumerate(paths):
        part = spark.read.option("lineSep", "\n").text(_copied(spark, sys.stdin) if path == "-" else path)
        part = part.select(F.lit(i).alias("arg"), "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), "value")
        found = part if found is None else found.unionByName(part)
    cut = scratch(spark)
    stretches = cut(found.mapInPandas(lambda batches: _stretches(batches, size), _STRETCHES), "stretches")
    # A row for each split: the headers in it, and the name and bases of its last record.
    own, size_ = F.col("record") > 0, F.length("residues")
    splits = stretches.groupBy("arg", "file_path", "block").agg(F.max("record").alias("headers"), F.max(F.when(F.col("last"), F.col("start") + size_)).alias("tail"), F.max(F.when(F.col("last"), F.col("name"))).alias("latest"))
    order, file = Window.orderBy("arg", "file_path", "block"), Window.partitionBy("arg", "file_path").orderBy("block")
    splits = splits.withColumn("before", F.coalesce(F.sum("headers").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    splits = splits.withColumn("opened", F.sum((F.col("headers") > 0).cast("long")).over(file)).withColumn("latest", F.last("latest", ignorenulls=True).over(file))
    # The record that is open at a split's end began in the last split with a header: bases since then.
    splits = splits.withColumn("carried", F.sum("tail").over(Window.partitionBy("arg", "file_path", "opened").orderBy("block")))
    splits = cut(splits.select("arg", "file_path", "block", "before", *(F.lag(c).over(file).alias(c) for c in ("carried", "opened", "latest"))), "splits")
    splits = F.broadcast(splits) if splits.count() <= SPLITS else splits
    placed = stretches.join(splits, ["arg", "file_path", "block"]).filter(own | ((F.col("opened") > 0) & (size_ > 0)))
    placed = placed.select((F.col("before") + F.col("record") - 1).alias("seq_id"), F.coalesce("name", "latest").alias("name"), F.when(own, F.col("start")).otherwise(F.col("start") + F.col("carried")).alias("start"), masked("residues", exclude).alias("residues"), (own & ~F.col("last")).alias("whole"))
    whole = placed.filter("whole").select("seq_id", "name", F.expr(f"start div {size}").alias("chunk"), "residues")
    # The others are cut at multiples of size and joined.
    parts = placed.filter("not whole").withColumn("chunk", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + greatest(length(residues), 1) - 1) div {size}"))))
    low = F.greatest(F.col("start"), F.col("chunk") * size)
    parts = parts.select("seq_id", "name", "chunk", F.struct(low.alias("low"), F.col("residues").substr((low - F.col("start") + 1).cast("int"), (F.col("chunk") * size + size - low).cast("int")).alias("residues")).alias("part"))
    joined = parts.groupBy("seq_id", "chunk").agg(F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["residues"]), "").alias("residues"))
    return whole.unionByName(joined)


def record_text(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def numbered_fasta(seqs: DataFrame, key: str = "seq_id", name: str = "name", seq: str = "residues") -> DataFrame:
    """key, value: records whose headers begin with their number, from 1."""
    own = numbered(seqs.select(key, name, seq), key, "_n")
    return own.select(key, record_text(F.concat_ws(" ", F.col("_n").cast("string"), name), F.col(seq)).alias("value"))


def fine_header(name: Column, offset: Column, number: Column | None = None, show_offsets: bool = False) -> Column:
    """Header of an expansion: ' [n ]name[ (offset o)]'."""
    parts = [F.lit(" ")]
    if number is not None:
        parts += [number.cast("string"), F.lit(" ")]
    parts.append(name)
    if show_offsets:
        parts += [F.lit(" (offset "), offset.cast("string"), F.lit(")")]
    return F.concat(*parts)


def write_fasta(records: DataFrame, path: str, column: str = "value") -> None:
    """Writes records of text, several files; a path that exists is an error."""
    records.select(column).write.mode("errorifexists").text(path)
