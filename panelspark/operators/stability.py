"""Which features keep their correlation with the target across regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.correlation import spearman_features
from panelspark.operators.pairs import ratio_correlations

# Limits of the three stability tests and of the selections.
MIN_REGIME_ROWS = 50
WEAK_CORRELATION = 0.01
MAX_DROP = 0.5
PURGE_MIN_CORRELATION = 0.005
ENGINE_MIN_CORRELATION = 0.01
MIN_SCORE = 0.01
MAX_FEATURES = 200
SIMPLE_MAX_FEATURES = 50
MAX_RATIOS = 10
RATIO_EPS = 1e-8
RATIO_VALID_SHARE = 0.8
RATIO_MIN_CORRELATION = 0.01


def position(features: list[str]) -> Column:
    """Place of ``feature`` in the given list, the tie-breaker of every selection."""
    return F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int")


def regime_correlations(
    df: DataFrame, features: list[str], target: str, regime: str = "regime"
) -> DataFrame:
    """(regime, feature, corr, n) over all rows of each regime."""
    return spearman_features(df, [regime], features, target)


def _summary(corrs: DataFrame, used: Column, sign_used: Column, regime: str) -> DataFrame:
    c = F.when(used, F.col("corr"))
    return corrs.groupBy("feature").agg(
        F.count(c).alias("n_regimes"),
        F.size(F.collect_set(F.when(used & sign_used, F.signum("corr")))).alias("n_signs"),
        F.max(F.abs(c)).alias("max_corr"),
        F.min(F.abs(c)).alias("min_corr"),
        F.avg(F.abs(c)).alias("mean_correlation"),
        F.stddev_pop(c).alias("correlation_std"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(used, F.struct(regime, "corr"))))
        ).alias("regime_correlations"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(used, F.struct(regime, "n"))))
        ).alias("regime_samples"),
    )


def _verdict(
    summary: DataFrame,
    features: list[str],
    min_regimes: int,
    one_sign: Column,
    strong: Column,
    too_few: str,
) -> DataFrame:
    enough = F.col("n_regimes") >= min_regimes
    drop = F.coalesce(
        F.try_divide(F.col("max_corr") - F.col("min_corr"), F.col("max_corr")), F.lit(0.0)
    )
    steady = F.col("magnitude_drop") <= MAX_DROP
    score = F.col("mean_correlation") * (1 - F.least(F.col("correlation_std"), F.lit(1.0)))
    reason = (
        F.when(~enough, too_few)
        .when(F.col("stable"), "stable")
        .when(~F.col("sign_consistent"), "sign_flip")
        .when(~steady, "magnitude_drop")
        .otherwise("weak_corr")
    )
    return (
        summary.withColumns({"magnitude_drop": F.when(enough, drop), "sign_consistent": enough & one_sign})
        .withColumn("stable", enough & F.col("sign_consistent") & steady & F.coalesce(strong, F.lit(False)))
        .withColumn("stability_score", F.when(enough, score).otherwise(0.0))
        .withColumn("stable", F.coalesce("stable", F.lit(False)))
        .withColumn("reason", reason)
        .withColumn("pos", position(features))
        .select(
            "feature",
            "pos",
            "stable",
            "reason",
            "n_regimes",
            "sign_consistent",
            "magnitude_drop",
            "mean_correlation",
            "correlation_std",
            "stability_score",
            "regime_correlations",
            "regime_samples",
        )
    )


def stability_purge(
    df: DataFrame,
    features: list[str],
    target: str,
    regime: str = "regime",
    min_rows: int = MIN_REGIME_ROWS,
) -> DataFrame:
    """Needs two regimes; correlations up to 0.01 in size do not count as a sign."""
    corrs = regime_correlations(df, features, target, regime)
    used = (F.col("n") >= min_rows) & F.col("corr").isNotNull()
    summary = _summary(corrs, used, F.abs("corr") > WEAK_CORRELATION, regime)
    return _verdict(
        summary,
        features,
        2,
        F.col("n_signs") <= 1,
        F.col("mean_correlation") >= PURGE_MIN_CORRELATION,
        "insufficient_regime_data",
    )


def stability_engine(
    df: DataFrame,
    features: list[str],
    target: str,
    regime: str = "regime",
    min_rows: int = MIN_REGIME_ROWS,
) -> DataFrame:
    """One regime is enough; every sign counts, zero included; ``unknown`` is a regime."""
    corrs = regime_correlations(df, features, target, regime)
    used = (F.col("n") >= min_rows) & F.col("corr").isNotNull()
    summary = _summary(corrs, used, F.lit(True), regime)
    return _verdict(
        summary,
        features,
        1,
        F.col("n_signs") == 1,
        F.col("mean_correlation") > ENGINE_MIN_CORRELATION,
        "no_valid_regime_correlations",
    )


def stability_simple(
    df: DataFrame, features: list[str], target: str, regime: str = "regime"
) -> DataFrame:
    """No minimum of rows or strength; drop = 1 - smallest/largest."""
    corrs = regime_correlations(df, features, target, regime)
    summary = _summary(corrs, F.col("corr").isNotNull(), F.lit(True), regime)
    drop = F.coalesce(1 - F.try_divide(F.col("min_corr"), F.col("max_corr")), F.lit(1.0))
    some = F.col("n_regimes") > 0
    return summary.select(
        "feature",
        position(features).alias("pos"),
        (some & (F.col("n_signs") <= 1) & (drop <= MAX_DROP)).alias("stable"),
        F.when(some, F.col("n_signs") > 1).alias("sign_flip"),
        F.when(some, drop).alias("drop"),
        "regime_correlations",
    )


def select_survivors(
    verdicts: DataFrame, min_score: float = MIN_SCORE, limit: int = MAX_FEATURES
) -> DataFrame:
    keep = F.col("stable") & (F.col("stability_score") >= min_score)
    return verdicts.where(keep).orderBy(F.col("stability_score").desc(), "pos").limit(limit)


def curate_features(
    verdicts: DataFrame, ratios: DataFrame | None = None, limit: int = MAX_FEATURES
) -> DataFrame:
    """(feature, kind, score): stable features by score, then the selected ratios."""
    stable = (
        verdicts.where("stable")
        .orderBy(F.col("stability_score").desc(), "pos")
        .limit(limit)
        .select("feature", F.lit("stable").alias("kind"), F.col("stability_score").alias("score"))
    )
    if ratios is None:
        return stable
    return stable.unionByName(
        ratios.select("feature", F.lit("ratio").alias("kind"), F.col("score"))
    )


def curate_simple(verdicts: DataFrame, limit: int = SIMPLE_MAX_FEATURES) -> DataFrame:
    return verdicts.where("stable").orderBy("pos").limit(limit).select("feature", "pos")


def pairs_of(features: list[str], limit: int | None = None) -> list[tuple[str, str]]:
    """Feature name pairs i < j in order; names only, no data."""
    pairs = []
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            if limit is not None and len(pairs) >= limit:
                return pairs
            pairs.append((a, b))
    return pairs


def ratio_of(a: str, b: str, eps: float = RATIO_EPS) -> Column:
    return F.col(a).cast("double") / (F.abs(F.col(b).cast("double")) + eps)


def select_ratios(
    df: DataFrame,
    stable: list[str],
    target: str,
    limit: int = MAX_RATIOS,
    pool: int | None = None,
) -> DataFrame:
    """Ratios of stable pairs ranked by absolute rank correlation with the target.

    Returns (feature, numerator, denominator, score); pairs with under 80% valid
    rows or a correlation up to 0.01 are dropped. All stable features take part, or the first
    ``pool`` of them. Pairs are rows, so the plan does not grow with them.
    """
    used = stable if pool is None else stable[:pool]
    if len(used) < 2:
        return df.sparkSession.createDataFrame(
            [], "feature string, numerator string, denominator string, score double")
    corrs = ratio_correlations(df, used, target, RATIO_EPS, RATIO_VALID_SHARE)
    names = F.array(*[F.lit(f) for f in used])
    return (
        corrs.withColumn("score", F.abs("corr"))
        .where(F.col("score") > RATIO_MIN_CORRELATION)
        .orderBy(F.col("score").desc(), "pair")
        .limit(limit)
        .select(names[F.col("i")].alias("numerator"), names[F.col("j")].alias("denominator"), "score")
        .select(F.concat_ws("_over_", "numerator", "denominator").alias("feature"), "numerator", "denominator", "score")
    )


def curation_summary(
    verdicts: DataFrame, survivors: int = 0, engineered: int = 0
) -> DataFrame:
    """Counts of a curation run as one row."""
    final = F.lit(survivors + engineered)
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if("stable").alias("stable_features"),
        F.lit(survivors).cast("long").alias("survivor_features"),
        F.lit(engineered).cast("long").alias("engineered_features"),
        final.cast("long").alias("final_features"),
        F.coalesce(F.avg(F.when(F.col("stable"), F.col("stability_score"))), F.lit(0.0)).alias(
            "average_stability_score"
        ),
        F.coalesce(F.try_divide(final.cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias(
            "survival_rate"
        ),
    )
