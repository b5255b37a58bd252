"""What the jobs share: config files, logs, and sequences out of tables."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import fields
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dna import normalised, text_residues

log = logging.getLogger("strandlake.jobs")


def configured(kind: type, path: str | None, **given):
    """An instance of a config class from a JSON file and values that are given; unknown names are an error."""
    found = json.loads(Path(path).read_text()) if path else {}
    found |= {k: v for k, v in given.items() if v is not None}
    if unknown := sorted(found.keys() - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**found)


def residues(column: str, encoding: str) -> Column:
    """encoding: 'bases' for nucleotides as they are, 'text' for prose whose letters stand for bases. Null is empty."""
    if encoding not in ("bases", "text"):
        raise ValueError("encoding must be 'bases' or 'text'")
    value = F.coalesce(F.col(column), F.lit(""))
    return normalised(value) if encoding == "bases" else text_residues(value)


class Watch:
    """Logs what was read and written, and how fast."""

    def __init__(self):
        self.began = time.perf_counter()

    def tell(self, what: str, rows: int, **more: int) -> None:
        seconds = time.perf_counter() - self.began
        log.info("%s: %s, %.0f rows a second since the start", what, ", ".join(f"{k} {v}" for k, v in {"rows": rows, **more}.items()), rows / max(seconds, 1e-9))


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
