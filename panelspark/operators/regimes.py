"""Volatility regimes of eras and what is derived from them (era-level tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.functions.ranking import draw_of, exact_median, smallest_draws
from panelspark.session import bounded


def label_by_level(
    indicator: DataFrame,
    low: float = expr.LOW_LEVEL,
    high: float = expr.HIGH_LEVEL,
    labels=expr.LONG_LABELS,
    out: str = "regime",
) -> DataFrame:
    return indicator.withColumn(out, expr.regime_by_level(F.col("vix"), low, high, labels))


def join_indicator(
    df: DataFrame, indicator: DataFrame, fill: str | None = None, era: str = "era"
) -> DataFrame:
    """Adds ``vix`` by era. ``fill="median"`` fills gaps with the median over joined rows.

    That median needs only rows per era: it is a weighted median of the era values.
    """
    small = bounded(indicator.select(era, "vix"))
    out = df.join(small, era, "left")
    if fill is None:
        return out
    if fill != "median":
        raise ValueError("fill must be None or 'median'")
    sizes = df.groupBy(era).agg(F.count(F.lit(1)).alias("n")).join(small, era)
    middle = exact_median(
        sizes.withColumn("_all", F.lit("all")), ["_all"], "vix", weight="n"
    )
    return out.withColumn("vix", F.coalesce("vix", middle.select("median").scalar()))


def join_regimes(
    df: DataFrame, labels: DataFrame, regime: str = "regime", era: str = "era"
) -> DataFrame:
    """Adds an era's label; eras without one are ``unknown``."""
    out = df.join(bounded(labels.select(era, regime)), era, "left")
    return out.withColumn(regime, F.coalesce(regime, F.lit("unknown")))


def _trailing(window: int):
    return Window.orderBy("era").rowsBetween(-(window - 1), 0)


def _percentile(value: str, window: int) -> Column:
    """Percent rank, average ties, of the last value in its trailing window."""
    seen = F.collect_list(value).over(_trailing(window))
    below = F.size(F.filter(seen, lambda v: v < F.col(value)))
    same = F.size(F.filter(seen, lambda v: v == F.col(value)))
    rank = F.try_divide(below + (same + 1) / 2, F.size(seen)) * 100
    return F.when(F.col(value).isNotNull(), rank)


def rolling_percentile(indicator: DataFrame, window: int = 60, value: str = "vix") -> DataFrame:
    return indicator.withColumn("percentile", _percentile(value, window))


def regime_by_percentile(
    indicator: DataFrame, window: int = 60, high: float = 75.0, low: float = 25.0
) -> DataFrame:
    crisis, grind, middle, _ = expr.LONG_LABELS
    p = F.col("percentile")
    return rolling_percentile(indicator, window).withColumn(
        "regime", F.when(p >= high, crisis).when(p <= low, grind).otherwise(middle)
    )


def rolling_features(
    indicator: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 60), value: str = "vix"
) -> DataFrame:
    made = {}
    for n in windows:
        made[f"{value}_mean_{n}d"] = F.avg(value).over(_trailing(n))
        made[f"{value}_std_{n}d"] = F.stddev_samp(value).over(_trailing(n))
        made[f"{value}_percentile_{n}d"] = _percentile(value, n)
    return indicator.withColumns(made)


def regime_changed(labels: DataFrame, regime: str = "regime") -> DataFrame:
    last = F.lag(regime).over(Window.orderBy("era"))
    return labels.withColumn(
        "regime_changed", (~F.col(regime).eqNullSafe(last)).cast("int")
    )


def regime_transitions(labels: DataFrame, regime: str = "regime") -> DataFrame:
    last = F.lag(regime).over(Window.orderBy("era"))
    return (
        labels.withColumn("_last", last)
        .where(F.col("_last").isNotNull() & (F.col("_last") != F.col(regime)))
        .groupBy(F.concat_ws("_to_", "_last", regime).alias("transition"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def regime_stats(labels: DataFrame, regime: str = "regime", value: str = "vix") -> DataFrame:
    n = F.count(F.lit(1))
    return labels.groupBy(regime).agg(
        n.alias("n"),
        (n * 100.0 / F.sum(n).over(Window.partitionBy())).alias("percentage"),
        F.avg(value).alias("vix_mean"),
        F.stddev_samp(value).alias("vix_std"),
        F.min(value).alias("vix_min"),
        F.max(value).alias("vix_max"),
    )


def regime_distribution(df: DataFrame, regime: str = "regime") -> DataFrame:
    return df.groupBy(regime).agg(F.count(F.lit(1)).alias("n"))


def indicator_stats(indicator: DataFrame, value: str = "vix") -> DataFrame:
    return indicator.agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def one_hot_regime(labels: DataFrame, regime: str = "regime") -> DataFrame:
    """``regime_<label>`` columns for the labels present (three or four)."""
    names = [r[0] for r in labels.select(regime).distinct().orderBy(regime).collect()]
    return labels.withColumns(expr.one_hot(F.col(regime), [n for n in names if n is not None]))


def regime_splits(
    df: DataFrame, low: float = expr.LOW_LEVEL, high: float = expr.HIGH_LEVEL
) -> dict[str, DataFrame]:
    """Rows per regime by thresholds; rows without indicator are in none."""
    vix = F.col("vix")
    return {
        "grind": df.where(vix < low),
        "transition": df.where((vix >= low) & (vix <= high)),
        "crisis": df.where(vix > high),
    }


def purge_regimes(
    df: DataFrame,
    low: float = expr.LOW_LEVEL,
    high: float = expr.HIGH_LEVEL,
    era_lists: dict[str, list[str]] | None = None,
    sample_size: int | None = None,
    seed: int = 42,
    era: str = "era",
) -> DataFrame:
    """Rows with the regime they are tested in.

    With an indicator column: three levels, missing values in transition, and no
    normal rows are left. Otherwise by named era lists, plus the remaining rows, or
    a repeatable sample of them, as ``normal_periods``. An era in two lists counts
    in both.
    """
    if "vix" in df.columns:
        v = F.col("vix")
        label = F.when(v > high, "crisis").when(v < low, "grind").otherwise("transition")
        return df.withColumn("regime", label)
    pairs = [F.struct(F.lit(n).alias("regime"), F.lit(e).alias("e"))
             for n, eras in (era_lists or {}).items() for e in eras]
    if not pairs:
        named = df.withColumn("regime", F.lit(None).cast("string")).limit(0)
        return named.unionByName(normal_periods(df, None, sample_size, seed))
    lists = F.array(*pairs)
    hits = F.transform(F.filter(lists, lambda p: p["e"] == F.col(era)), lambda p: p["regime"])
    named = df.withColumn("regime", F.explode(hits))
    listed = sorted({e for eras in era_lists.values() for e in eras})
    return named.unionByName(normal_periods(df, listed, sample_size, seed, era))


def normal_periods(
    df: DataFrame, listed: list[str] | None, sample_size: int | None, seed: int = 42, era="era"
) -> DataFrame:
    """Rows in no listed era, optionally a fixed-size repeatable sample of them."""
    rest = df if not listed else df.where(~F.col(era).isin(listed))
    rest = rest.withColumn("regime", F.lit("normal_periods"))
    if sample_size is None:
        return rest
    return smallest_draws(rest, ["regime"], draw_of([F.col(c) for c in df.columns], seed), sample_size)
