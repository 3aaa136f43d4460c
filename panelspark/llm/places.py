"""Places of rows in the order of their group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import bounded, written


def indexed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, the place in the group from 0, and ``n``, the group's size.

    Rows are cut into near equal ranges of (group, order), sorted and written once with their place;
    a range's start in its group is a running sum over ranges. Equal rows are cut by their place in the input, so no
    group and no mass of equal rows has to fit in a task. The group is never null.
    """
    keys = [group, *order, "_from"]
    placed = written(
        rows.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(*keys)
        .sortWithinPartitions(*keys).drop("_from").withColumn("_at", F.monotonically_increasing_id()),
        name).withColumn("_range", F.shiftright("_at", 33))
    ranges = W.partitionBy(group).orderBy("_range")
    starts = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        group, "_range", "_first",
        F.coalesce(F.sum("_n").over(ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    starts = written(starts, f"{name}-ranges")
    return placed.join(bounded(starts), [group, "_range"]).withColumn(
        "idx", F.col("_start") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_start")
