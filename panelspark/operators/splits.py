"""Era-aware splits and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ranking import cut_by_draw, draw_of, smallest_draws
from panelspark.session import bounded
from panelspark.sources.panel import era_index


def split_bounds(n_eras: int, n_splits: int = 5, gap: int = 100) -> list[tuple]:
    """(fold, train_from, train_to, val_from, val_to) as 1-based era positions."""
    if n_eras < 4 * n_splits + gap:
        raise ValueError(
            f"{n_eras} eras are too few for {n_splits} splits with gap {gap}: "
            f"at least {4 * n_splits + gap} are needed"
        )
    size = max(1, (n_eras - gap) // (3 * n_splits - 1))
    bounds, start = [], 1
    for fold in range(n_splits):
        train_to = min(start + size - 1, n_eras)
        val_from = train_to + gap + 1
        if val_from > n_eras:
            break
        val_to = min(val_from + size - 1, n_eras)
        bounds.append((fold, start, train_to, val_from, val_to))
        start = val_to + 1
    return bounds


def era_cv_splits(
    df: DataFrame, n_splits: int = 5, gap: int = 100, era: str = "era"
) -> DataFrame:
    """(fold, role, era): which eras train and validate each fold."""
    eras = era_index(df, era)
    bounds = split_bounds(eras.count(), n_splits, gap)
    spans = [
        F.struct(
            F.lit(fold).alias("fold"),
            F.lit(role).alias("role"),
            F.lit(low).alias("low"),
            F.lit(high).alias("high"),
        )
        for fold, t0, t1, v0, v1 in bounds
        for role, low, high in (("train", t0, t1), ("val", v0, v1))
    ]
    here = F.filter(
        F.array(*spans),
        lambda s: (s["low"] <= F.col("era_idx")) & (F.col("era_idx") <= s["high"]),
    )
    return eras.select(era, "era_idx", F.inline(here)).select("fold", "role", era, "era_idx")


def fold_rows(df: DataFrame, splits: DataFrame, era: str = "era") -> DataFrame:
    """Rows with the fold and role they belong to (a row may serve several folds)."""
    return df.join(bounded(splits.select("fold", "role", era)), era)


def check_era_gap(train: DataFrame, test: DataFrame, min_gap: int, era: str = "era") -> DataFrame:
    """(max_train, min_test, gap, passed); eras that are not numbers pass."""
    def ends(df: DataFrame, side) -> Column:
        number = F.col(era).try_cast("int")
        return df.agg(F.struct(side(number).alias("end"), F.max(number.isNull()).alias("odd")).alias("e")).scalar()

    row = train.sparkSession.range(1).select(
        ends(train, F.max).alias("a"), ends(test, F.min).alias("b")
    ).select(
        F.col("a.end").alias("max_train"),
        F.col("b.end").alias("min_test"),
        F.coalesce(F.col("a.odd") | F.col("b.odd"), F.lit(True)).alias("unparseable"),
    )
    gap = F.col("min_test") - F.col("max_train")
    return row.select(
        "max_train",
        "min_test",
        gap.alias("gap"),
        (F.col("unparseable") | F.coalesce(gap >= min_gap, F.lit(True))).alias("passed"),
    )


def _draw(df: DataFrame, seed: int, keys: list[str] | None) -> Column:
    """A repeatable random order; rows equal in all keys share one draw."""
    return draw_of([F.col(c) for c in keys or df.columns], seed)


def sample_per_era(
    df: DataFrame, n: int, seed: int = 42, keys: list[str] | None = None, era: str = "era"
) -> DataFrame:
    """At most ``n`` rows per era without replacement, the same on every run."""
    return smallest_draws(df, [era], _draw(df, seed, keys), n)


def train_test_split(
    df: DataFrame,
    share: float = 0.7,
    seed: int = 42,
    keys: list[str] | None = None,
    era: str = "era",
) -> DataFrame:
    """Adds ``is_train``: exactly floor(share * n) rows per era in a repeatable order.

    Equal rows are parted like any others, as many as the share needs.
    """
    quota = F.floor(F.lit(share) * F.col("_total"))
    return cut_by_draw(df, [era], _draw(df, seed, keys), quota).withColumnRenamed("_chosen", "is_train")
