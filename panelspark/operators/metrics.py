"""Scores of eras, predictions and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.functions.correlation import spearman
from panelspark.functions.ranking import median_and_mad
from panelspark.session import written

# Tolerances of the degenerate and Sharpe checks.
CONSTANT_TOLERANCE = 1e-12
SHARPE_EPS = 1e-9
MAD_TO_STD = 1.4826


def era_sanity(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, n_unique, range, std, mean, MAD and is_constant per group; NULLs are left out."""
    rows = df.where(F.col(value).isNotNull())
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.round(value, 12)).alias("n_unique"),
        (F.max(value) - F.min(value)).alias("range"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.avg(value).alias("mean"),
    )
    mad = median_and_mad(rows, groups, value).drop("median")
    tol = CONSTANT_TOLERANCE
    return base.join(mad, groups).withColumn(
        "is_constant",
        (F.col("n_unique") <= 1)
        | (F.col("range") < tol)
        | (F.col("std") < tol)
        | (F.col("mad") < tol),
    )


def safe_sharpe(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Sharpe ratio per group with degenerate cases told apart by ``reason``."""
    checked = era_sanity(df, groups, value)
    thin = F.col("std") < SHARPE_EPS
    robust = F.try_divide(F.col("mean"), MAD_TO_STD * F.col("mad") + SHARPE_EPS)
    reason = (
        F.when(F.col("is_constant"), "degenerate")
        .when(thin & (F.col("mad") < SHARPE_EPS), "zero_var_and_mad")
        .when(thin, "robust")
        .otherwise("ok")
    )
    return checked.withColumn("reason", reason).withColumn(
        "sharpe",
        F.when(F.col("reason") == "robust", robust).when(
            F.col("reason") == "ok", F.try_divide(F.col("mean"), F.col("std") + SHARPE_EPS)
        ),
    )


def realistic_sharpe(
    df: DataFrame, groups: list[str], value: str, bps: float = expr.TRANSACTION_COST_BPS
) -> DataFrame:
    """Sharpe of era correlations before and after costs; zeros for no eras."""
    mean, std = F.avg(value), F.stddev_samp(value)
    sharpe = F.when(std > 0, F.try_divide(mean, std)).otherwise(0.0)
    impact = expr.cost_impact(bps)
    none = F.count(value) == 0
    aggs = [
        sharpe.alias("sharpe_ratio"),
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), sharpe - impact)).alias("sharpe_with_tc"),
        F.when(none, 0.0).otherwise(F.lit(impact)).alias("tc_impact"),
        mean.alias("mean_correlation"),
        std.alias("std_correlation"),
        F.count(value).alias("n_eras"),
    ]
    return df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)


def transaction_cost(
    df: DataFrame, groups: list[str], prediction: str, bps: float = expr.TRANSACTION_COST_BPS
) -> DataFrame:
    """Sharpe of the predictions themselves before and after the cost impact."""
    std = F.stddev_samp(prediction)
    sharpe = F.when(std > 0, F.try_divide(F.avg(prediction), std)).otherwise(0.0)
    impact = expr.cost_impact(bps)
    return df.groupBy(*groups).agg(
        sharpe.alias("sharpe"),
        (sharpe - impact).alias("sharpe_after_cost"),
        F.lit(impact).alias("tc_impact"),
    )


def finite_stats(df: DataFrame, value: str) -> DataFrame:
    x = expr.finite(F.col(value))
    return df.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def scopes(df: DataFrame, era: str = "era", regime: str | None = "regime") -> DataFrame:
    """Each row once per scope: overall, its era and its regime."""
    parts = [
        F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("key")),
        F.struct(F.lit("era").alias("scope"), F.col(era).cast("string").alias("key")),
    ]
    if regime:
        parts.append(F.struct(F.lit("regime").alias("scope"), F.col(regime).alias("key")))
    return df.withColumn("_scope", F.explode(F.array(*parts))).select(
        *df.columns, F.col("_scope.scope").alias("scope"), F.col("_scope.key").alias("key")
    )


def correlations_by_scope(
    df: DataFrame,
    prediction: str = "prediction",
    target: str = "target",
    extra: tuple[str, ...] = (),
    era: str = "era",
    regime: str | None = "regime",
) -> DataFrame:
    """Rank correlation overall, per era and per regime in one job; ``df`` is worked out once."""
    kept = df.select(*dict.fromkeys([*extra, era, prediction, target] + ([regime] if regime else [])))
    rows = scopes(written(kept, "scored-rows"), era, regime)
    return spearman(
        rows.where(F.col("key").isNotNull()), [*extra, "scope", "key"], prediction, target
    )


def summarise_scopes(
    corrs: DataFrame, extra: tuple[str, ...] = (), bps: float = expr.TRANSACTION_COST_BPS
) -> DataFrame:
    """Metric rows from scoped correlations: overall, Sharpe set, and one per regime."""
    eras = corrs.where((F.col("scope") == "era") & (F.col("n") > 1))
    sharpe = realistic_sharpe(eras, list(extra), "corr", bps)
    metrics = ["sharpe_ratio", "sharpe_with_tc", "mean_correlation", "std_correlation", "n_eras"]
    tidy = sharpe.select(
        *extra,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in metrics
                ]
            )
        ),
    )
    name = F.when(F.col("scope") == "overall", "overall_correlation").otherwise(
        F.concat(F.lit("corr_"), F.col("key"))
    )
    return corrs.where(F.col("scope") != "era").select(
        *extra, name.alias("metric"), F.col("corr").alias("value")
    ).unionByName(tidy)


def evaluate_predictions(
    df: DataFrame,
    prediction: str = "prediction",
    target: str = "target",
    era: str = "era",
    regime: str | None = "regime",
) -> DataFrame:
    return summarise_scopes(correlations_by_scope(df, prediction, target, (), era, regime))
