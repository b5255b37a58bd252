"""Running totals and dense numbers without putting all rows into one task.

Rows are sorted into ranges of the key, one to a partition, and written. Totals
of the partitions, a row for each, are accumulated first, then rows within
their partition. So how far keys lie apart makes no difference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.scratch import scratch

Cut = Callable[[DataFrame, str], DataFrame]
#: Bits of a row's number within its partition, in numbers that Spark gives.
WITHIN = 33


def _placed(df: DataFrame, order: tuple[str, ...], cut: Cut | None) -> DataFrame:
    """df in ranges of order, with _p, the partition, and _i, the row's number in it. It is written, as a range may differ when it is made again."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = (cut or scratch(df.sparkSession))(ranged, "ranges")
    return placed.withColumn("_p", F.shiftright("_m", WITHIN)).withColumn("_i", F.col("_m").bitwiseAND((1 << WITHIN) - 1)).drop("_m")


def _offsets(placed: DataFrame, value: Column) -> DataFrame:
    """_p, _o: the total of all partitions before. One row for a partition, so one task and a broadcast are enough."""
    totals = placed.groupBy("_p").agg(F.sum(value).cast("long").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")))


def running_total(df: DataFrame, key: str, value: Column, name: str, cut: Cut | None = None) -> DataFrame:
    """df with ``name``: the total of value over all rows of smaller key. key: distinct."""
    placed = _placed(df.withColumn("_v", value.cast("long")), (key,), cut)
    within = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(_offsets(placed, F.col("_v")), "_p").withColumn(name, F.col("_o") + F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return out.drop("_p", "_i", "_v", "_o")


def numbered(df: DataFrame, key: str | tuple[str, ...], name: str, first: int = 1, cut: Cut | None = None) -> DataFrame:
    """df with ``name``: dense numbers by key, one column or several, from first."""
    placed = _placed(df, (key,) if isinstance(key, str) else key, cut)
    return placed.join(_offsets(placed, F.lit(1)), "_p").withColumn(name, F.col("_o") + F.col("_i") + first).drop("_p", "_i", "_o")
