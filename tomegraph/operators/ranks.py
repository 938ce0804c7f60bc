"""Global ranks and running sums without a window over the whole table (FLT-1, FLT-4, WIN-10, WIN-11).

An ordered frame is range-partitioned already, so the place of a row is its place in its partition
plus the sizes of those before. The frame is written once, the sizes (a row a partition) come to the
driver, and nothing is shuffled after the sort itself.

Rows of equal sort keys stand in one partition: order by something that tells most rows apart.
Defined cases: an empty frame gives no rows; null values add nothing to a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

_PLACE_BITS = 33  # of monotonically_increasing_id()


def _laid(df: DataFrame) -> DataFrame:
    t = materialise(df.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    return t.withColumns({"_part": F.shiftright("_id", _PLACE_BITS), "_place": F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))})


def _with_before(t: DataFrame, total: Column, kind: str) -> DataFrame:
    """t with _before, the total of all partitions ahead of the row's own."""
    before, rows = 0, []
    for r in t.groupBy("_part").agg(total.alias("total")).orderBy("_part").toLocalIterator():
        rows.append((r._part, before))
        before += r.total or 0
    return t.join(F.broadcast(t.sparkSession.createDataFrame(rows, f"_part long, _before {kind}")), "_part")


def numbered(ordered: DataFrame, rank: str = "rank") -> DataFrame:
    """The rows of a frame that orderBy() made, with their places from 1 (long)."""
    t = _with_before(_laid(ordered), F.count("*"), "long")
    return t.withColumn(rank, F.col("_before") + F.col("_place") + 1).select(*ordered.columns, rank)


def running(ordered: DataFrame, value: Column, total: str = "total") -> DataFrame:
    """The rows of a frame that orderBy() made, with the sum of value (long) up to and with each row."""
    t = _laid(ordered.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    t = _with_before(t, F.sum("_value"), "long").withColumn(total, F.col("_before") + own)
    return t.select(*ordered.columns, total)
