"""Exact ranks, quantiles and per-group top rows that do not need a group to fit in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import bounded, written

# Leading bits of a draw that the histograms of samples and splits count.
SLOT_BITS = 16
DRAW_BITS = 60


def distribution(
    values: DataFrame, groups: list[str], value: str, weight: str = "weight"
) -> DataFrame:
    """Adds ``below`` (weight of smaller values) and ``total`` (weight of the group).

    ``values`` holds one row per (group, value). They are written once, cut into ranges of
    (group, value); as these pairs are unique, no range is much larger than another, however
    much one group holds. Ranks are running sums inside a range, plus the sums of the group's
    earlier ranges.
    """
    return placed_ranks(in_ranges(values, groups, value), groups, value, weight)


def in_ranges(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``values`` written once, with the number of their range as ``_bucket``."""
    ranged = values.repartitionByRange(*groups, value).withColumn("_bucket", F.spark_partition_id())
    return written(ranged, "values")


def placed_ranks(
    placed: DataFrame, groups: list[str], value: str, weight: str = "weight"
) -> DataFrame:
    """``distribution`` of values that ``in_ranges`` has written."""
    by_group = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = (
        placed.groupBy(*groups, "_bucket")
        .agg(F.sum(weight).alias("_here"))
        .select(
            *groups,
            "_bucket",
            F.coalesce(
                F.sum("_here").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.sum("_here")
            .over(by_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias("total"),
        )
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value)
    before = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        placed.withColumn("_before", F.coalesce(before, F.lit(0)))
        .join(offsets, [*groups, "_bucket"])
        .withColumn("below", F.col("_before") + F.col("_offset"))
        .drop("_before", "_offset", "_bucket")
    )


def counted(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (group, non-null value) with its weight; combines before the shuffle."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(size.alias("weight"))


def exact_median(
    df: DataFrame,
    groups: list[str],
    value: str,
    out: str = "median",
    weight: str | None = None,
) -> DataFrame:
    """Exact (weighted by row count) median per group; never holds a group in memory."""
    return _middle(distribution(counted(df, groups, value, weight), groups, value), groups, value, out)


def _middle(dist: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    end = F.col("below") + F.col("weight")
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    has_low = (F.col("below") <= low) & (low < end)
    has_high = (F.col("below") <= high) & (high < end)
    return (
        dist.where(has_low | has_high)
        .groupBy(*groups)
        .agg(
            (
                (
                    F.sum(F.when(has_low, F.col(value)))
                    + F.sum(F.when(has_high, F.col(value)))
                )
                / 2
            ).alias(out)
        )
    )


def median_and_mad(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, median, mad): the MAD comes from the counted values of the median, not from rows again."""
    dist = distribution(counted(df, groups, value), groups, value)
    middle = bounded(_middle(dist, groups, value, "median"))
    away = dist.select(*groups, value, "weight").join(middle, groups).select(
        *groups, F.abs(F.col(value) - F.col("median")).alias("_away"), "weight")
    return middle.join(exact_median(away, groups, "_away", "mad", "weight"), groups)


def top_rows(
    df: DataFrame, groups: list[str], order: list[Column], n: int, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every group, in two rounds so that a hot group is shared out.

    Copies of one row share a salt; the optimizer's group limit below row_number()
    keeps at most ``n`` of them per map task.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*groups, "_salt").orderBy(*order)
    last = Window.partitionBy(*groups).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(last))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )


def draw_of(keys: list[Column], seed: int) -> Column:
    """A repeatable random number of DRAW_BITS bits from a row's keys; equal keys draw alike.

    It is the head of an MD5 digest, so that other engines can draw the same.
    """
    texts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def _slots(drawn: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, _slot, _n, _below, _total): a histogram of the draws' leading bits."""
    earlier = Window.partitionBy(*groups).orderBy("_slot")
    whole = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return drawn.groupBy(*groups, "_slot").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {
            "_below": F.coalesce(
                F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "_total": F.sum("_n").over(whole),
        }
    )


def cut_by_draw(df: DataFrame, groups: list[str], draw: Column, quota: Column) -> DataFrame:
    """Adds ``_chosen``: the ``quota`` rows with the smallest draws of each group, exactly.

    ``quota`` may use ``_total``, the group's size. A histogram, combined before the shuffle,
    finds the one slot of each group that the quota cuts; only its rows are ordered, ties by
    a hash of all columns. Every other row is decided by its slot.
    """
    columns = df.columns
    shift = DRAW_BITS - SLOT_BITS
    drawn = df.withColumn("_draw", draw).withColumn("_slot", F.shiftright("_draw", shift))
    cuts = (
        _slots(drawn, groups)
        .withColumn("_quota", quota.cast("long"))
        .where((F.col("_below") <= F.col("_quota")) & (F.col("_quota") < F.col("_below") + F.col("_n")))
        .select(*groups, F.col("_slot").alias("_cut"), (F.col("_quota") - F.col("_below")).alias("_left"))
    )
    # a group whose quota is its size has no cut slot: all its rows are chosen
    marked = drawn.join(bounded(cuts), groups, "left")
    order = Window.partitionBy(*groups).orderBy("_draw", F.xxhash64(*columns))
    edge = marked.where(F.col("_slot") == F.col("_cut")).withColumn(
        "_chosen", F.row_number().over(order) <= F.col("_left")
    )
    rest = marked.where(F.col("_cut").isNull() | (F.col("_slot") != F.col("_cut"))).withColumn(
        "_chosen", F.col("_cut").isNull() | (F.col("_slot") < F.col("_cut"))
    )
    return rest.select(*columns, "_chosen").unionByName(edge.select(*columns, "_chosen"))


def smallest_draws(df: DataFrame, groups: list[str], draw: Column, n: int) -> DataFrame:
    """Exactly the ``n`` rows with the smallest draw per group (all rows of smaller groups)."""
    chosen = cut_by_draw(df, groups, draw, F.least(F.lit(n), F.col("_total")))
    return chosen.where("_chosen").drop("_chosen")
