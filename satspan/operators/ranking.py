"""Places in a total order, and what comes later in it, without one task for all.

Rows are dealt out by range and written; a row's place is that in its part plus
the rows of the parts before.  Only a row per part meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satspan.sources.shared import written


def dealt(df: DataFrame, *order: str, label: str = "ranking") -> DataFrame:
    """``df`` with ``_part`` and ``_place``: parts, and places in them, in order."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # The id holds the part in its upper bits and the row's place below.
    return written(rows, label).withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def numbered_rows(df: DataFrame, out: str, *order: str) -> DataFrame:
    """``df`` with ``out``, the row's number from 0 in the order of ``order``."""
    rows = dealt(df, *order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def least_of_later(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` (a row for each ``order``) with ``out``: the least ``value`` of the rows
    that come after in the order, null if none has one."""
    rows = dealt(df, order)
    ends = rows.groupBy("_part").agg(F.min(value).alias("_least"))
    after = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = ends.select("_part", F.min("_least").over(after).alias("_beyond"))
    within = Window.partitionBy("_part").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_mine", F.min(value).over(within)).join(F.broadcast(later), "_part")
    return both.withColumn(out, F.least("_mine", "_beyond")).drop("_part", "_place", "_mine", "_beyond")
