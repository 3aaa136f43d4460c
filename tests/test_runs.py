import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, metrics, models
from panelspark.plans import fixtures as fx
from panelspark.plans import runs


@pytest.fixture(scope="module")
def panel(spark, sf):
    return fx.panel(spark, sf)


def test_discovery_run(panel):
    names = ["feature_price", "feature_discount", "feature_tax"]
    weights, edges, wide = runs.discovery_run(panel, names, fx.TARGETS, warmup=3)
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    assert weights.where(F.abs(total - 1) > 1e-9).count() == 0
    assert "adaptive_target" in wide.columns and wide.count() == panel.count()
    assert edges.columns == ["f1_idx", "f2_idx", "feature1", "feature2", "strength"]


def test_stability_run(spark, sf, panel):
    verdicts, curated = runs.stability_run(panel, fx.indicator(spark, sf), fx.FEATURES, "target_net")
    stable = {r["feature"] for r in verdicts.where("stable").collect()}
    assert "feature_price" in stable and "feature_flip" not in stable
    assert curated.count() >= len(stable)


def test_purge_run(spark, sf, panel):
    names = [*fx.FEATURES, "target_gross"]
    _, final, wide = runs.purge_run(panel, fx.indicator(spark, sf), names, "target_net")
    assert "feature_price" in final and set(final) <= set(wide.columns)
    assert any(n.startswith("ratio_") for n in final) and any(n.endswith("_neutralized") for n in final)
    _, fallback, _ = runs.purge_run(panel, fx.indicator(spark, sf), ["feature_tax"], "target_net")
    assert fallback == ["feature_tax"]


def test_regime_model_run(spark, sf, panel):
    out = runs.regime_model_run(
        panel.where("era_idx <= 40"), panel.where("era_idx > 50"), fx.indicator(spark, sf),
        ["feature_quantity", "feature_discount", "feature_flip"], "target_net",
        settings=boosting.Settings(rounds=2, depth=2),
    )
    assert {r["metric"] for r in out.collect()} >= {"overall_correlation", "sharpe_ratio"}


def _marked(spark, frame, column, kind):
    """(a table that is worked out row by row, how many rows it was asked for)"""
    seen = spark.sparkContext.accumulator(0)

    def touch(value):
        seen.add(1)
        return value

    df = spark.createDataFrame(frame).repartition(3)
    return df.withColumn(column, F.udf(touch, kind)(column)), seen


def test_evaluation_works_out_its_rows_once(spark):
    rows = [(f"{i % 4:04d}", "ab"[i % 2], float(i % 7), float(i * 37 % 41)) for i in range(200)]
    df, seen = _marked(spark, pd.DataFrame(rows, columns=["era", "regime", "target", "prediction"]), "prediction", "double")
    df = df.withColumn("target", F.col("target") + 0 * F.col("prediction"))
    found = {r["metric"]: r["value"] for r in metrics.evaluate_predictions(df).collect()}
    table = pd.DataFrame(rows, columns=["era", "regime", "target", "prediction"])
    assert found["overall_correlation"] == pytest.approx(table["target"].rank().corr(table["prediction"].rank()), abs=1e-9)
    assert seen.value == len(rows)


def test_purge_run_works_out_its_rows_once(spark):
    rows = [(f"{i % 4:04d}", float(i * 37 % 41), float(i % 41 * 3), float(i * 37 % 41) + i % 5) for i in range(800)]
    df, seen = _marked(spark, pd.DataFrame(rows, columns=["era", "feature_a", "feature_b", "y"]), "y", "double")
    indicator = spark.createDataFrame([("0000", 30.0), ("0001", 10.0), ("0002", 20.0), ("0003", 20.0)], "era string, vix double")
    _, final, wide = runs.purge_run(df, indicator, ["feature_a", "feature_b"], "y")
    assert "feature_a" in final
    assert wide.count() == len(rows)
    assert seen.value == len(rows)


def test_cross_validation_works_out_its_rows_once(spark):
    rows = [(f"{i // 4:04d}", "ab"[i % 2], float(i * 37 % 41), float(i * 37 % 41) + i % 5) for i in range(4 * 240)]
    df, seen = _marked(spark, pd.DataFrame(rows, columns=["era", "regime", "x", "y"]), "era", "string")
    tests = models.cross_validate(df, ["x"], "y", 2, 200)["honesty"].first()
    assert tests["n_tests"] >= 1
    assert seen.value == len(rows)
