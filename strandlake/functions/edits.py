"""Edit scripts: how an original piece differs from the coarse piece it is linked to.

A script is a list of edits, each an operation (i inserts before a coarse base,
s replaces coarse bases, where '-' drops one), the distance in alignment
columns from the start of the edit before, in octal, and the bases. Direction
is a column of its own, not part of the script.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "([is])([0-7]+)([A-Z-]+)"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def reverse_complement(seq: str) -> str:
    return seq[::-1].translate(_COMPLEMENT)


def script_of(org: str, ref: str) -> str:
    """The script of two aligned strings of one length, '-' marking gaps."""
    kinds = ("" if a == b else "i" if b == "-" else "s" for a, b in zip(org, ref, strict=True))
    parts, at, last = [], 0, 0
    for kind, run in groupby(kinds):
        n = sum(1 for _ in run)
        if kind:
            parts.append(f"{kind}{at - last:o}{org[at : at + n]}")
            last = at
        at += n
    return "".join(parts)


def edits_of(script: str) -> Iterator[tuple[str, int, str]]:
    """(operation, distance, bases) of each edit."""
    at = 0
    while at < len(script):
        kind, at, distance = script[at], at + 1, 0
        while at < len(script) and script[at] in "01234567":
            distance, at = 8 * distance + int(script[at]), at + 1
        begin = at
        while at < len(script) and script[at] not in "is":
            at += 1
        yield kind, distance, script[begin:at]


def applied(script: str, coarse: str, forward: bool = True) -> str:
    """The original piece: the script applied to the coarse piece, reverse-complemented if not forward."""
    out, pos, column, last = [], 0, 0, 0
    for kind, distance, bases in edits_of(script):
        same = last + distance - column
        out.append(coarse[pos : pos + same])
        pos += same
        out.append(bases.replace("-", ""))
        pos += len(bases) if kind == "s" else 0
        last += distance
        column = last + len(bases)
    whole = "".join(out) + coarse[pos:]
    return whole if forward else reverse_complement(whole)


@F.pandas_udf(T.StringType())
def make_script(org: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else script_of(a, b) for a, b in zip(org, ref, strict=True)], dtype=object)


def tokens(script: Column | str) -> Column:
    """array<struct<op, dist, str>>: the edits of a script, in built-in functions."""
    found = F.regexp_extract_all(script if isinstance(script, Column) else F.col(script), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.regexp_extract(t, TOKEN, 1).alias("op"), F.conv(F.regexp_extract(t, TOKEN, 2), 8, 10).cast("int").alias("dist"), F.regexp_extract(t, TOKEN, 3).alias("str")))


def apply_script(script: Column, coarse: Column, forward: Column) -> Column:
    """The original piece, in built-in functions: one fold over the edits."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"), F.lit(0).alias("col"), F.lit(0).alias("last"))

    def step(acc: Column, e: Column) -> Column:
        same = acc["last"] + e["dist"] - acc["col"]
        used = acc["pos"] + same + F.when(e["op"] == "s", F.length(e["str"])).otherwise(0)
        out = F.concat(acc["out"], coarse.substr(acc["pos"] + 1, same), F.translate(e["str"], "-", ""))
        return F.struct(out.alias("out"), used.alias("pos"), (acc["last"] + e["dist"] + F.length(e["str"])).alias("col"), (acc["last"] + e["dist"]).alias("last"))

    whole = F.when(script == "", coarse).otherwise(F.aggregate(tokens(script), start, step, lambda acc: F.concat(acc["out"], coarse.substr(acc["pos"] + 1, F.length(coarse)))))
    return F.when(forward, whole).otherwise(F.reverse(F.translate(whole, "ACGT", "TGCA")))
