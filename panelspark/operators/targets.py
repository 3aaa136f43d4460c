"""Blending target columns with per-era weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.sources.panel import prefixed
from panelspark.session import bounded


def tidy_to_arrays(tidy: DataFrame, era: str = "era") -> DataFrame:
    """(era, target_idx, w) rows to one weight array per era."""
    cells = F.array_sort(F.collect_list(F.struct("target_idx", "w")))
    return tidy.groupBy(era).agg(cells["w"].alias("weights"))


def join_weights(
    df: DataFrame, weights: DataFrame, default: Column | None, era: str = "era"
) -> DataFrame:
    """Adds ``weights`` by era; eras without weights get ``default``."""
    out = df.join(bounded(weights.select(era, "weights")), era, "left")
    return out if default is None else out.withColumn("weights", F.coalesce("weights", default))


def adaptive_target(
    df: DataFrame,
    weights: DataFrame,
    targets: list[str] | None = None,
    era: str = "era",
    out: str = "adaptive_target",
) -> DataFrame:
    """Weighted mean of the usable targets, weights renormalised per row."""
    targets = targets or prefixed(df.columns, "target")
    joined = join_weights(df, weights, expr.equal_weights(len(targets)), era)
    blend = expr.renormalised_dot([F.col(t) for t in targets], F.col("weights"))
    return joined.withColumn(out, blend).drop("weights")


def mean_weights(weights: DataFrame, k: int = 0, era: str = "era") -> DataFrame:
    """(target_idx, w): mean weight over the last ``k`` eras; all eras when k <= 0."""
    if k > 0:
        latest = F.row_number().over(Window.orderBy(F.col(era).desc()))
        weights = weights.withColumn("_rank", latest).where(F.col("_rank") <= k)
    cells = weights.select(era, F.posexplode("weights").alias("target_idx", "w"))
    return cells.groupBy("target_idx").agg(F.avg("w").alias("w"))


def _as_array(tidy: DataFrame) -> Column:
    cells = F.array_sort(F.collect_list(F.struct("target_idx", "w")))
    return tidy.agg(cells["w"].alias("weights")).scalar()


def adaptive_target_ensemble(
    df: DataFrame,
    weights: DataFrame,
    k: int = 0,
    targets: list[str] | None = None,
    era: str = "era",
    out: str = "adaptive_target",
) -> DataFrame:
    """One mean weight vector applied to every row; targets in name order."""
    targets = targets or sorted(prefixed(df.columns, "target"))
    mean = _as_array(mean_weights(weights, k, era))
    return (
        df.withColumn("_w", mean)
        .withColumn(out, expr.plain_dot([F.col(t) for t in targets], F.col("_w")))
        .drop("_w")
    )


def adaptive_target_per_era(
    df: DataFrame,
    weights: DataFrame,
    fallback: str = "ensemble",
    k: int = 0,
    targets: list[str] | None = None,
    era: str = "era",
    out: str = "adaptive_target",
) -> DataFrame:
    """Plain dot with the era's weights; other eras use ensemble, last or equal weights."""
    targets = targets or sorted(prefixed(df.columns, "target"))
    if fallback == "ensemble":
        default = _as_array(mean_weights(weights, k, era))
    elif fallback == "last":
        default = weights.agg(F.max_by("weights", era).alias("weights")).scalar()
    elif fallback == "equal":
        default = expr.equal_weights(len(targets))
    else:
        raise ValueError("fallback must be ensemble, last or equal")
    joined = join_weights(df, weights, default, era)
    return joined.withColumn(
        out, expr.plain_dot([F.col(t) for t in targets], F.col("weights"))
    ).drop("weights")


def adaptive_target_apply(
    df: DataFrame,
    weights: DataFrame,
    targets: list[str] | None = None,
    era: str = "era",
    out: str = "adaptive_target",
) -> DataFrame:
    """Plain dot; equal weights when the era is missing or its vector has another length."""
    targets = targets or prefixed(df.columns, "target")
    if not targets:
        raise ValueError("no target columns")
    equal = expr.equal_weights(len(targets))
    joined = join_weights(df, weights, None, era)
    fit = F.when(F.size("weights") == len(targets), F.col("weights")).otherwise(equal)
    return (
        joined.withColumn("_w", fit)
        .withColumn(out, expr.plain_dot([F.col(t) for t in targets], F.col("_w")))
        .drop("_w", "weights")
    )


def weight_report(
    weights: DataFrame, targets: list[str], warmup: int = 20, era: str = "era"
) -> DataFrame:
    """Per target: mean weight over all and over discovered eras, how often and how much active."""
    ranked = weights.withColumn("_idx", F.row_number().over(Window.orderBy(era)))
    cells = ranked.select("_idx", F.posexplode("weights").alias("target_idx", "w"))
    found = F.col("_idx") > warmup
    active = found & (F.col("w") > 1e-9)
    names = F.array(*[F.lit(t) for t in targets])
    return cells.groupBy("target_idx").agg(
        F.element_at(names, F.col("target_idx") + 1).alias("target"),
        F.avg("w").alias("mean_all"),
        F.avg(F.when(found, F.col("w"))).alias("mean_discovered"),
        F.avg(F.when(found, active.cast("double"))).alias("active_share"),
        F.coalesce(
            F.try_divide(F.sum(F.when(found, F.col("w"))), F.count_if(active)), F.lit(0.0)
        ).alias("mean_when_active"),
    )


def weight_drift(weights: DataFrame, era: str = "era") -> DataFrame:
    """Cosine with the previous era's weights, and the effective number of targets."""
    last = F.lag("weights").over(Window.orderBy(era))
    squares = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    return weights.withColumn("_last", last).select(
        era,
        expr.cosine(F.col("weights"), F.col("_last")).alias("drift"),
        F.when(squares > 0, F.try_divide(F.lit(1.0), squares))
        .otherwise(F.lit(float("inf")))
        .alias("effective_targets"),
    )
