"""Numbering rows in a global order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.session import stored

# Rows that one task sorts.
RANGE_ROWS = 1_000_000


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`, 1 for the first row of the order. The order must leave no ties open.

    Rows are dealt by ranges of the order, some `RANGE_ROWS` to a range; each range is counted
    (one number per range comes to the driver) and numbered from where the ranges before it end.
    """
    rows = stored(rows, "unnumbered")
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    begins = rows.sparkSession.createDataFrame(starts, "_range int, _begin long")
    placed = dealt.withColumn(name, within).join(F.broadcast(begins), "_range")
    return placed.withColumn(name, F.col(name) + F.col("_begin")).select(*rows.columns, name)
