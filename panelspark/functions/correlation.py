"""Pearson and rank correlation per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ranking import counted, in_ranges, placed_ranks
from panelspark.functions.runs import run_correlations
from panelspark.session import hashed

# Above this many columns rows are unfolded from an array instead of an expand node.
MAX_UNPIVOT = 64


def _coded(df: DataFrame, ids: list[str], features: list[str], value: str) -> DataFrame:
    """One row per (row, feature) with the feature as its position ``_pos``."""
    cells = [F.col(f).cast("double").alias(f"_c{i}") for i, f in enumerate(features)]
    if len(features) <= MAX_UNPIVOT:
        names = [f"_c{i}" for i in range(len(features))]
        long = df.select(*ids, *cells).unpivot(ids, names, "_name", value)
        return long.select(*ids, F.substring("_name", 3, 9).cast("int").alias("_pos"), value)
    return df.select(*ids, F.posexplode(F.array(*cells)).alias("_pos", value))


def _named(features: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_pos") + 1).alias("feature")


def to_long(df: DataFrame, ids: list[str], features: list[str], value: str = "value") -> DataFrame:
    """One row per (row, feature): ``ids``, ``feature``, ``value``."""
    return _coded(df, ids, features, value).select(*ids, _named(features), value)


def pearson_of(x: str, y: str) -> Column:
    """Pearson aggregate over complete pairs; NULL when a side is constant."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(whole, F.col(x)), F.when(whole, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(
    df: DataFrame, groups: list[str], x: str, y: str, out: str = "corr", missing: float | None = None
) -> DataFrame:
    """Pearson per group; ``missing`` replaces an undefined correlation."""
    corr = pearson_of(x, y)
    if missing is not None:
        corr = F.coalesce(corr, F.lit(float(missing)))
    return df.groupBy(*groups).agg(corr.alias(out), F.count(F.lit(1)).alias("n"))


def _centred_rank(weight: str = "weight") -> Column:
    """Average rank, centred and divided by the group size, so sums keep their precision."""
    return (
        F.col("below") + (F.col(weight) + 1) / 2 - (F.col("total") + 1) / 2
    ) / F.col("total")


def joined_rank(df: DataFrame, groups: list[str], y: str, weight: str | None = None) -> tuple[DataFrame, int]:
    """(``df`` with ``_ry``, the target's rank in its group; how many rows have a target).

    The ranked distinct values are joined, so rows stay spread over all tasks however few groups there
    are. Few distinct values are broadcast and frequent ones split by adaptive execution, which sees both sides' sizes.
    The value is the first join key: sorts tell rows apart by a number's bits and seldom compare group names.
    Ranks that fit in the tasks are hashed, so that rows need no sort.
    """
    placed = in_ranges(counted(df, groups, y, weight), groups, y)
    rows, values = placed.agg(F.sum("weight"), F.count(F.lit(1))).first()
    ranks = placed_ranks(placed, groups, y).select(*groups, y, _centred_rank().alias("_ry"))
    return df.join(hashed(ranks, values), [y, *groups], "left").select(*df.columns, "_ry"), int(rows or 0)


def spearman(
    df: DataFrame,
    groups: list[str],
    x: str,
    y: str,
    weight: str | None = None,
    out: str = "corr",
    omit: bool = False,
) -> DataFrame:
    """Average-rank correlation per group, with row count ``n``.

    A group with an incomplete pair has a NULL correlation; with ``omit`` such
    pairs are left out instead. ``weight`` is the multiplicity of a row.
    """
    keep = [*groups, x, y] + ([weight] if weight else [])
    rows = df.select(*dict.fromkeys(keep))
    if omit:
        rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked, size = joined_rank(rows, groups, y, weight)
    corrs = run_correlations(ranked, groups, [x], size, weight, sampled=rows)
    return corrs.select(*groups, F.col("corr").alias(out), "n")


def spearman_features(
    df: DataFrame,
    groups: list[str],
    features: list[str],
    y: str,
    out: str = "corr",
) -> DataFrame:
    """``spearman`` of every feature with one target: (groups, feature, corr, n).

    The target is ranked once per group; rows then become sorted runs of every feature.
    """
    rows = df.select(*dict.fromkeys([*groups, *features, y]))
    ranked, size = joined_rank(rows, groups, y)
    corrs = run_correlations(ranked, groups, features, size, sampled=rows)
    return corrs.select(*groups, _named(features), F.col("corr").alias(out), "n")
