"""End-to-end runs: the operators in the order in which they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import discovery, features, models, relations, stability, targets
from panelspark.operators.metrics import evaluate_predictions
from panelspark.operators.regimes import join_indicator, purge_regimes, regime_by_percentile, join_regimes
from panelspark.session import written

# Fixed value: survivors whose ratios and differences are made.
MATH_BASE = 50


def discovery_run(
    df: DataFrame, feature_names: list[str], target_names: list[str], **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights per era, relationships, and the panel with adaptive target and path features."""
    weights = written(
        discovery.walk_forward_weights(df, feature_names, target_names, **options), "weights"
    )
    blended = targets.adaptive_target(df, weights, target_names)
    mined = relations.mine_relationships(blended, feature_names, "adaptive_target")
    edges = relations.top_relationships(mined.edges)
    return weights, edges, features.interaction_features(blended, edges)


def stability_run(
    df: DataFrame, indicator: DataFrame, feature_names: list[str], target: str
) -> tuple[DataFrame, DataFrame]:
    """Verdicts under percentile regimes and the curated list with its ratio expressions."""
    labelled = join_regimes(df, regime_by_percentile(indicator))
    # written once: verdicts and ratios would each work out the panel several times
    labelled = written(labelled.select("regime", *dict.fromkeys([*feature_names, target])), "labelled-rows")
    verdicts = written(stability.stability_engine(labelled, feature_names, target), "verdicts")
    stable = [
        r["feature"]
        for r in stability.curate_features(verdicts).collect()
    ]
    ratios = stability.select_ratios(labelled, stable, target)
    return verdicts, stability.curate_features(verdicts, ratios)


def purge_run(
    df: DataFrame, indicator: DataFrame, feature_names: list[str], target: str
) -> tuple[DataFrame, list[str], DataFrame]:
    """Purge verdicts, the final feature names, and the panel that has them all.

    When nothing survives, the input features are used.
    """
    # written once: verdicts, neutralisation and the caller would each work out the panel several times
    rows = written(join_indicator(df, indicator), "purge-rows")
    verdicts = written(
        stability.stability_purge(purge_regimes(rows), feature_names, target), "verdicts"
    )
    survivors = [r["feature"] for r in stability.select_survivors(verdicts).collect()]
    if not survivors:
        return verdicts, feature_names, rows
    made = features.math_features(rows, survivors[:MATH_BASE])
    made = features.neutralize(made, survivors, target)
    new = [c for c in made.columns if c not in rows.columns]
    return verdicts, survivors + new, made


def regime_model_run(
    train: DataFrame, valid: DataFrame, indicator: DataFrame, names: list[str], target: str, **options
) -> DataFrame:
    """Metrics of one boosted-tree model per regime on later rows."""
    fitted = models.train_by_regime(join_indicator(train, indicator), names, target, **options)
    scored = models.predict_by_regime(join_indicator(valid, indicator), fitted, names)
    short = F.when(F.col("vix") > 25, "crisis").when(F.col("vix") < 15, "grind").when(
        F.col("vix").isNotNull(), "transition"
    )
    return evaluate_predictions(scored.withColumn("regime", short), target=target)
