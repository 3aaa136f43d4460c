import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import regimes, targets
from panelspark.plans import fixtures, target_queries
from panelspark.session import bounded

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("1", 1.0, 2.0, 3.0),
        ("1", NAN, 2.0, 3.0),
        ("1", None, None, INF),
        ("2", 1.0, 2.0, 3.0),
        ("3", 1.0, 2.0, 6.0),
        ("4", 2.0, 4.0, 6.0),
    ]
    return spark.createDataFrame(data, "era string, target_a double, target_b double, target_c double")


@pytest.fixture(scope="module")
def weights(spark):
    data = [("1", [0.5, 0.25, 0.25]), ("2", [0.0, 0.0, 0.0]), ("4", [1.0, 0.0])]
    return spark.createDataFrame(data, "era string, weights array<double>")


def values(df):
    return [r["adaptive_target"] for r in df.orderBy("era", F.col("target_a").desc_nulls_last()).collect()]


def test_renormalised_blend(rows, weights):
    w = weights.where("era <> '4'")
    got = sorted(values(targets.adaptive_target(rows, w)))
    # full row, NaN dropped, nothing usable, zero weights -> equal, era missing -> equal
    want = sorted([1.75, 2.5, 0.0, 2.0, 3.0, 4.0])
    assert got == pytest.approx(want)


def test_apply_uses_equal_weights_for_wrong_length(rows, weights):
    got = targets.adaptive_target_apply(rows.where("era in ('3', '4')"), weights)
    assert values(got) == pytest.approx([3.0, 4.0])


@pytest.mark.parametrize(
    "fallback,want", [("ensemble", 0.5 * 1 + 0.35 * 2 + 0.15 * 6), ("last", 0.6 + 0.8), ("equal", 3.0)]
)
def test_per_era_fallbacks(spark, rows, fallback, want):
    w = spark.createDataFrame(
        [("1", [0.4, 0.3, 0.3]), ("2", [0.6, 0.4, 0.0])], "era string, weights array<double>"
    )
    got = targets.adaptive_target_per_era(rows.where("era = '3'"), w, fallback)
    assert values(got) == pytest.approx([want])
    with pytest.raises(ValueError):
        targets.adaptive_target_per_era(rows, w, "other")


def test_drift_and_effective_targets(spark):
    w = spark.createDataFrame(
        [("1", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [0.0, 0.0]), ("4", [0.0, 0.0])],
        "era string, weights array<double>",
    )
    got = targets.weight_drift(w).orderBy("era").collect()
    assert [r["drift"] for r in got] == [1.0, 0.0, 0.0, 1.0]
    assert got[0]["effective_targets"] == 1.0 and math.isinf(got[2]["effective_targets"])


def test_level_labels_at_the_limits(spark):
    df = spark.createDataFrame([(v,) for v in (15.0, 25.0, 14.9, 25.1, None)], "vix double")
    got = [r["regime"] for r in regimes.label_by_level(df).collect()]
    assert got == ["transition", "transition", "low_vol_grind", "high_vol_crisis", "unknown"]


def test_reference_indicator_values(spark):
    df = spark.createDataFrame(list(zip(range(1, 6), (15.0, 28.0, 22.0, 12.0, 35.0))), "era int, vix double")
    got = [r["regime"] for r in regimes.label_by_level(df).orderBy("era").collect()]
    assert got == ["transition", "high_vol_crisis", "transition", "low_vol_grind", "high_vol_crisis"]


def test_unmatched_era_and_median_fill(spark):
    p = spark.createDataFrame([("1",), ("1",), ("1",), ("2",), ("9",)], "era string")
    ind = spark.createDataFrame([("1", 10.0), ("2", 40.0)], "era string, vix double")
    labelled = regimes.join_regimes(p, regimes.label_by_level(ind))
    assert {r["era"]: r["regime"] for r in labelled.collect()}["9"] == "unknown"
    filled = regimes.join_indicator(p, ind, fill="median")
    assert {r["era"]: r["vix"] for r in filled.collect()}["9"] == 10.0  # three rows of 10, one of 40


def test_rolling_percentile_first_is_full(spark):
    df = spark.createDataFrame([("1", 3.0), ("2", 1.0), ("3", 3.0)], "era string, vix double")
    got = [r["percentile"] for r in regimes.rolling_percentile(df, 60).orderBy("era").collect()]
    assert got == pytest.approx([100.0, 50.0, 2.5 / 3 * 100])


def test_changes_and_transitions(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "a")], "era string, regime string")
    assert [r["regime_changed"] for r in regimes.regime_changed(df).orderBy("era").collect()] == [1, 0, 1, 1]
    assert {r["transition"]: r["n"] for r in regimes.regime_transitions(df).collect()} == {
        "a_to_b": 1,
        "b_to_a": 1,
    }


def test_splits_leave_missing_indicator_out(spark):
    df = spark.createDataFrame([(10.0,), (15.0,), (25.0,), (30.0,), (None,)], "vix double")
    sizes = {k: v.count() for k, v in regimes.regime_splits(df).items()}
    assert sizes == {"grind": 1, "transition": 2, "crisis": 1}


def test_purge_regimes(spark):
    df = spark.createDataFrame([(10.0,), (None,), (30.0,)], "vix double")
    got = sorted(r["regime"] for r in regimes.purge_regimes(df).collect())
    assert got == ["crisis", "grind", "transition"]
    eras = spark.range(100).select((F.col("id") % 10).cast("string").alias("era"), "id")
    rows = regimes.purge_regimes(eras, era_lists={"x": ["1"], "y": ["1", "2"]}, sample_size=15)
    assert {r["regime"]: r["count"] for r in rows.groupBy("regime").count().collect()} == {
        "x": 10,
        "y": 20,
        "normal_periods": 15,
    }


def test_dynamic_weights_sum_to_one(spark):
    df = spark.createDataFrame([(30.0,), (10.0,), (20.0,)], "vix double")
    shares = expr.dynamic_weights(F.col("vix"), {"crisis": F.lit(0.1), "grind": F.lit(-2.0)})
    for r in df.select(*[c.alias(k) for k, c in shares.items()]).collect():
        assert sum(r) == pytest.approx(1.0) and r["grind"] == 0.0
    none = expr.dynamic_weights(F.col("vix"), {k: F.lit(-1.0) for k in ("crisis", "grind", "transition")})
    assert all(sum(r) == 0.0 for r in df.select(*[c.alias(k) for k, c in none.items()]).collect())


def test_position_size_is_clipped(spark):
    df = spark.createDataFrame([(0.4, 0.5, "crisis"), (9.0, 1.0, "grind"), (0.4, 1.0, "odd")], "p double, c double, r string")
    got = [x[0] for x in df.select(expr.position_size(F.col("p"), F.col("c"), F.col("r"))).collect()]
    assert got == pytest.approx([0.1, 1.0, 0.2])


def test_tversky_value(spark):
    df = spark.createDataFrame([([True, True, False, False], [True, False, True, False])], "a array<boolean>, b array<boolean>")
    assert df.select(expr.tversky(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 - 0.7 - 0.3)


def test_array_median(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0, 2.0, 3.0],), ([],)], "v array<double>")
    got = [r[0] for r in df.select(expr.array_median(F.col("v"))).collect()]
    assert got == [2.0, 2.5, None]
    assert np.isclose(expr.cost_impact(), 25 / 1e4 / 0.15)


def test_calendar_is_worked_out_once_and_tells_days_of_any_time(spark, tmp_path, monkeypatch):
    times = pd.to_datetime(["2020-01-31 23:59:59", "2020-01-01", "2020-02-01", "2020-04-07 06:00", "1969-12-31 23:00", "2020-04-30", None], format="ISO8601")
    lines = pd.DataFrame({
        "l_orderkey": range(7), "l_linenumber": 1, "l_partkey": 2, "l_suppkey": 3, "l_quantity": 1.0, "l_extendedprice": 100.0,
        "l_discount": 0.1, "l_tax": 0.2, "l_shipdate": times})
    lines.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    pd.DataFrame({"o_orderkey": range(7), "o_totalprice": 50.0}).to_parquet(tmp_path / "orders.parquet")
    seen = []
    monkeypatch.setattr(fixtures, "bounded", lambda df: (seen.append(df), bounded(df))[1])
    got = {r["l_orderkey"]: r for r in target_queries.adaptive_target_ensemble(spark, str(tmp_path)).collect()}
    assert len(seen) == 1
    # rows without a date have the first era, which no row of the panel has
    assert {k: r["era"] for k, r in got.items()} == {4: "0002", 0: "0003", 1: "0003", 2: "0004", 3: "0005", 5: "0005"}
    weights = [np.mean([(1 + (era + k) % 3) / 6 for era in range(1, 6)]) for k in range(3)]
    assert got[0]["adaptive_target"] == pytest.approx(np.dot(weights, [120.0, 90.0, 50.0]), abs=1e-6)
    daily = {r["l_orderkey"]: r["era_idx"] for r in fixtures.panel(spark, str(tmp_path), "day").collect()}
    assert daily == {4: 2, 1: 3, 0: 4, 2: 5, 3: 6, 5: 7}
