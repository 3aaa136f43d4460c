"""Linear and boosted-tree models, overall and per regime, and their honest tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.functions.correlation import pearson, spearman
from panelspark.functions.moments import schema_of, second_moments
from panelspark.operators import boosting
from panelspark.operators.metrics import scopes, summarise_scopes
from panelspark.operators.splits import check_era_gap, era_cv_splits, fold_rows
from panelspark.session import bounded, written

# Sizes and limits of training and of the honesty test.
ENSEMBLE = boosting.Settings(rounds=100, depth=6, step=0.05, row_share=0.8, feature_share=0.8)
BY_REGIME = boosting.Settings(rounds=50, depth=5, step=0.05, row_share=0.8, feature_share=0.9)
FIRST_SEED, N_MODELS = 42, 5
MIN_REGIME_TRAIN_ROWS = 100
HONEST_DROP, HONEST_SCORE = 0.5, 0.8
MIN_VALIDATION_GAP = 200
REGIMES = ("crisis", "grind", "transition")
WHOLE = "all"


def linear_fit(
    df: DataFrame, features: list[str], target: str, groups: list[str]
) -> DataFrame:
    """(groups, n, intercept, coef) of ordinary least squares over complete rows.

    Means and covariances of all groups come from one aggregation; only those are solved.
    """
    p = len(features)
    columns = [*features, target]
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    rows = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).where(whole)
    moments = second_moments(rows, columns, groups)

    def solve(batches):
        for batch in batches:
            made = batch[[*groups, "n"]].copy()
            intercepts, coefs = [], []
            for m, c in zip(batch["mean"], batch["cov"]):
                c = np.asarray(c, dtype=np.float64).reshape(p + 1, p + 1)
                b = np.linalg.lstsq(c[:p, :p], c[:p, p], rcond=None)[0]
                coefs.append(b.tolist())
                intercepts.append(float(m[p] - np.dot(m[:p], b)))
            made["intercept"], made["coef"] = intercepts, coefs
            yield made

    return moments.mapInPandas(
        solve, f"{schema_of(df, groups)}, n long, intercept double, coef array<double>"
    )


def linear_predict(
    df: DataFrame, model: DataFrame, features: list[str], groups: list[str], out="prediction"
) -> DataFrame:
    """Adds the prediction of each row's group; NULL where the group has no model."""
    joined = df.join(bounded(model.select(*groups, "intercept", "coef")), groups, "left")
    value = F.col("intercept") + expr.plain_dot([F.col(f) for f in features], F.col("coef"))
    return joined.withColumn(out, value).drop("intercept", "coef")


def honesty(train_corr: Column, test_corr: Column) -> tuple[Column, Column]:
    """(drop, honesty score) of a train and a test correlation."""
    ratio = F.try_divide(test_corr, train_corr)
    known = train_corr.isNotNull() & test_corr.isNotNull() & (train_corr != 0)
    drop = F.when(known, 1 - ratio).otherwise(F.lit(float("inf")))
    score = F.when(
        known & (1 - ratio <= HONEST_DROP), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    ).otherwise(0.0)
    return drop, score


def honesty_by_group(
    rows: DataFrame, groups: list[str], features: list[str], target: str, role: str = "role"
) -> DataFrame:
    """Fits on ``train`` rows, ranks both roles: correlations, drop and honesty per group."""
    model = linear_fit(rows.where(F.col(role) == "train"), features, target, groups)
    scored = linear_predict(rows, model, features, groups)
    return honesty_of(spearman(scored, [*groups, role], "prediction", target), groups, role)


def honesty_of(corrs: DataFrame, groups: list[str], role: str = "role") -> DataFrame:
    """Both roles' correlations side by side, with drop and honesty."""
    def side(name):
        return F.max(F.when(F.col(role) == name, F.col("corr")))

    wide = corrs.groupBy(*groups).agg(
        side("train").alias("train_correlation"), side("val").alias("test_correlation")
    )
    drop, score = honesty(F.col("train_correlation"), F.col("test_correlation"))
    return wide.withColumns({"drop": drop, "honesty": score})


def time_machine_test(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    target: str,
    min_gap: int = MIN_VALIDATION_GAP,
    era: str = "era",
) -> DataFrame:
    """Trains on old eras and tests on later ones; raises when the eras are too close."""
    if era in train.columns and era in test.columns:
        if not check_era_gap(train, test, min_gap, era).first()["passed"]:
            raise ValueError(f"train and test eras are less than {min_gap} apart")
    keep = [*features, target]
    rows = train.select(*keep, F.lit("train").alias("role")).unionByName(
        test.select(*keep, F.lit("val").alias("role"))
    )
    tagged = rows.withColumn("_run", F.lit(0))
    return honesty_by_group(tagged, ["_run"], features, target).drop("_run")


def time_machine_summary(results: DataFrame) -> DataFrame:
    """Means over folds; NULLs are left out, nothing left counts as 0."""
    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    return results.agg(
        mean("train_correlation").alias("avg_train_corr"),
        mean("test_correlation").alias("avg_test_corr"),
        mean("drop").alias("avg_drop"),
        mean("honesty").alias("honesty_score"),
        F.count(F.lit(1)).alias("n_tests"),
    ).withColumn("honest", F.col("honesty_score") > HONEST_SCORE)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean, std, n) over folds, from (fold, metric, value) rows without NULLs.

    A regime counts when any fold has it.
    """
    return (
        metrics.where(F.col("value").isNotNull())
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    )


def cross_validate(
    df: DataFrame,
    features: list[str],
    target: str,
    n_splits: int = 5,
    gap: int = MIN_VALIDATION_GAP,
    regime: str | None = "regime",
    era: str = "era",
) -> dict[str, DataFrame]:
    """Linear cross-validation with gapped eras, all folds in one job.

    Returns ``metrics`` (fold, metric, value), ``summary``, ``time_machine`` per fold and
    ``honesty``. Fold is a key, so fits, predictions and ranks of all folds share a plan.
    """
    # written once: the eras and the folds would each work out ``df``
    df = written(df.select(*dict.fromkeys([era, *features, target] + ([regime] if regime else []))), "panel-rows")
    splits = era_cv_splits(df, n_splits, max(gap, MIN_VALIDATION_GAP), era)
    return validate_folds(df, splits, features, target, regime, era)


def validate_folds(
    df: DataFrame,
    splits: DataFrame,
    features: list[str],
    target: str,
    regime: str | None = "regime",
    era: str = "era",
) -> dict[str, DataFrame]:
    keep = [era, *features, target] + ([regime] if regime else [])
    rows = written(fold_rows(df.select(*dict.fromkeys(keep)), splits, era), "fold-rows")
    model = linear_fit(rows.where("role = 'train'"), features, target, ["fold"])
    scored = linear_predict(rows, model, features, ["fold"]).select(
        "fold", "role", *dict.fromkeys([era, *([regime] if regime else []), "prediction", target])
    )
    # train rows are ranked as a whole only, validation rows in every scope
    ranked = scopes(scored, era, regime).where(
        F.col("key").isNotNull() & ((F.col("role") == "val") | (F.col("scope") == "overall"))
    )
    corrs = spearman(ranked, ["fold", "role", "scope", "key"], "prediction", target)
    metrics = summarise_scopes(corrs.where("role = 'val'").drop("role"), ("fold",))
    tests = honesty_of(corrs.where("scope = 'overall'"), ["fold"])
    return {
        "metrics": metrics,
        "summary": fold_summary(metrics),
        "time_machine": tests,
        "honesty": time_machine_summary(tests),
    }


def train_ensemble(
    df: DataFrame,
    features: list[str],
    target: str,
    seeds: list[int] | None = None,
    settings: boosting.Settings = ENSEMBLE,
) -> boosting.Boosted:
    """One boosted-tree model per seed, all grown in the same passes over the rows with a target."""
    seeds = seeds or [FIRST_SEED + i for i in range(N_MODELS)]
    rows = df.select(F.lit(WHOLE).alias("_whole"), *dict.fromkeys([*features, target])).where(F.col(target).isNotNull())
    models = [boosting.ModelKey(WHOLE, (1.0,), seed) for seed in seeds]
    return boosting.boost(rows, features, [target], models, "_whole", settings)


def predict_ensemble(
    df: DataFrame, model: boosting.Boosted, features: list[str], out: str = "prediction"
) -> DataFrame:
    """Adds the mean prediction of all models; all required features must exist."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing}")
    return boosting.predict(df, model, F.lit(WHOLE), out)


def train_by_regime(
    df: DataFrame,
    features: list[str],
    target: str,
    settings: boosting.Settings = BY_REGIME,
    seed: int = FIRST_SEED,
) -> boosting.Boosted:
    """One model per regime with at least 100 rows, all in the same passes; needs a ``vix`` column."""
    if "vix" not in df.columns:
        raise ValueError("a vix column is needed")
    label = expr.regime_by_level(F.col("vix"), labels=expr.SHORT_LABELS)
    rows = df.select(label.alias("_regime"), *dict.fromkeys([*features, target])).where(
        F.col(target).isNotNull() & F.col("_regime").isNotNull())
    models = [boosting.ModelKey(regime, (1.0,), seed) for regime in REGIMES]
    return boosting.boost(rows, features, [target], models, "_regime", settings, least=MIN_REGIME_TRAIN_ROWS)


def predict_by_regime(
    df: DataFrame, model: boosting.Boosted, features: list[str], out: str = "prediction"
) -> DataFrame:
    """Each row by its regime's model; 0 without a model or an indicator."""
    label = expr.regime_by_level(F.col("vix"), labels=expr.SHORT_LABELS)
    return boosting.predict(df, model, label, out)


def fit_linear_by_regime(
    df: DataFrame, features: list[str], target: str, regime: str = "regime"
) -> DataFrame:
    return linear_fit(df.where(F.col(regime).isin(*REGIMES)), features, target, [regime])


def join_predictions(predictions: DataFrame, valid: DataFrame, key: str = "id") -> DataFrame:
    return predictions.join(valid, key, "inner")


def compare_models(
    predictions: dict[str, DataFrame], valid: DataFrame, target: str = "target", key: str = "id"
) -> DataFrame:
    """(model, corr, n): Pearson of each model's predictions with the validation target."""
    rows = None
    for name, table in predictions.items():
        part = table.select(key, "prediction", F.lit(name).alias("model"))
        rows = part if rows is None else rows.unionByName(part)
    return pearson(
        join_predictions(rows, valid.select(key, target), key), ["model"], "prediction", target
    )
