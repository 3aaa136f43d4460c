"""Ranks, medians and correlations against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import session
from panelspark.functions import runs
from panelspark.functions.correlation import pearson, spearman, spearman_features, to_long
from panelspark.functions.ranking import counted, distribution, exact_median, median_and_mad, top_rows


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 4000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    x = np.round(rng.normal(size=n), 2)
    y = np.where(rng.random(n) < 0.3, 0.5, rng.normal(size=n))  # a heavy tie
    return pd.DataFrame({"g": g, "x": x, "y": y, "c": 1.0})


def test_distribution_counts_smaller_values(spark, frame):
    df = spark.createDataFrame(frame)
    out = distribution(counted(df, ["g"], "y"), ["g"], "y")
    got = out.toPandas().set_index(["g", "y"]).sort_index()
    for g, part in frame.groupby("g"):
        values = np.sort(part["y"].to_numpy())
        for y in part["y"].unique()[:50]:
            row = got.loc[(g, y)]
            assert row["below"] == (values < y).sum()
            assert row["weight"] == (values == y).sum()
            assert row["total"] == len(values)


def test_spearman_equals_pandas(spark, frame):
    df = spark.createDataFrame(frame)
    got = {r["g"]: r for r in spearman(df, ["g"], "x", "y").collect()}
    for g, part in frame.groupby("g"):
        assert got[g]["corr"] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)
        assert got[g]["n"] == len(part)


def test_feature_form_equals_single_form(spark, frame):
    df = spark.createDataFrame(frame)
    many = spearman_features(df, ["g"], ["x", "c"], "y").collect()
    single = {r["g"]: r["corr"] for r in spearman(df, ["g"], "x", "y").collect()}
    for r in many:
        if r["feature"] == "c":
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(single[r["g"]], abs=1e-12)


def test_incomplete_pairs(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, 9.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    strict = {r["g"]: r["corr"] for r in spearman(df, ["g"], "x", "y").collect()}
    assert strict == {"a": None, "b": pytest.approx(-1.0)}
    omit = {r["g"]: r["corr"] for r in spearman(df, ["g"], "x", "y", omit=True).collect()}
    assert omit["a"] == pytest.approx(1.0)


def test_missing_target_makes_correlation_null(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, None), ("a", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = spearman(df, ["g"], "x", "y").first()
    assert out["corr"] is None and out["n"] == 3


def test_weighted_equals_repeated(spark, frame):
    df = spark.createDataFrame(frame)
    folded = df.groupBy("g", "x", "y").agg(F.count("*").alias("w"))
    plain = {r["g"]: r["corr"] for r in spearman(df, ["g"], "x", "y").collect()}
    for r in spearman(folded, ["g"], "x", "y", weight="w").collect():
        assert r["corr"] == pytest.approx(plain[r["g"]], abs=1e-12)


def test_result_does_not_depend_on_partitions(spark, frame):
    df = spark.createDataFrame(frame)
    one = spearman(df.repartition(1), ["g"], "x", "y").orderBy("g").collect()
    many = spearman(df.repartition(8, "x"), ["g"], "x", "y").orderBy("g").collect()
    for a, b in zip(one, many):
        assert a["corr"] == pytest.approx(b["corr"], abs=1e-12)


def test_exact_median(spark, frame):
    df = spark.createDataFrame(frame)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "y").collect()}
    want = frame.groupby("g")["y"].median()
    assert got == {g: pytest.approx(v) for g, v in want.items()}


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 2)], "g string, v double, n long")
    assert exact_median(df, ["g"], "v", weight="n").first()["median"] == 3.0


def test_median_and_mad_equal_pandas(spark, frame):
    df = spark.createDataFrame(frame)
    got = {r["g"]: r for r in median_and_mad(df, ["g"], "y").collect()}
    for g, part in frame.groupby("g"):
        middle = part["y"].median()
        assert got[g]["median"] == pytest.approx(middle)
        assert got[g]["mad"] == pytest.approx((part["y"] - middle).abs().median())


def test_pearson_guards(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["corr"] for r in pearson(df, ["g"], "x", "y", missing=0.0).collect()}
    assert got == {"a": pytest.approx(1.0), "b": 0.0}


def test_top_rows_is_exact_with_a_hot_group(spark, frame):
    df = spark.createDataFrame(frame.reset_index(names="id"))
    got = top_rows(df, ["g"], [F.col("y").desc(), F.col("id")], 7, salts=4).toPandas()
    want = (
        frame.reset_index(names="id").sort_values(["y", "id"], ascending=[False, True]).groupby("g").head(7)
    )
    assert set(got["id"]) == set(want["id"])


def test_long_form_of_wide_tables(spark):
    names = [f"f{i}" for i in range(70)]
    df = spark.createDataFrame([(1, *map(float, range(70)))], ["k", *names])
    got = {r["feature"]: r["value"] for r in to_long(df, ["k"], names).collect()}
    assert got == {f"f{i}": float(i) for i in range(70)}


@pytest.mark.parametrize("range_rows, held", [(1 << 20, 1 << 21), (40, 60)])
def test_runs_in_small_ranges_equal_pandas(spark, monkeypatch, range_rows, held):
    """Masses of ties, a null group, a group of one row and weights, with many ranges, runs and batches."""
    monkeypatch.setattr(runs, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(runs, "HELD", held)
    rng = np.random.default_rng(11)
    n = 900
    x = np.where(rng.random(n) < 0.4, 2.0, np.round(rng.normal(size=n), 2))
    table = pd.DataFrame({"g": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), "k": rng.integers(0, 2, n), "x": x, "z": -x**2,
                          "y": np.round(x + rng.normal(size=n), 1), "w": rng.integers(1, 4, n)})
    table.loc[0, ["g", "k"]] = ["one", 7]
    df = spark.createDataFrame(table).withColumn("g", F.when(F.col("g") != "NaN", F.col("g"))).repartition(6)
    got = {(r["g"], r["k"], r["feature"]): r for r in spearman_features(df, ["g", "k"], ["x", "z"], "y").collect()}
    heavy = {(r["g"], r["k"]): r for r in spearman(df, ["g", "k"], "x", "y", weight="w").collect()}
    for (g, k), part in table.groupby(["g", "k"]):
        for f in ("x", "z"):
            r = got[g, k, f]
            want = part[f].rank().corr(part["y"].rank())
            assert r["n"] == len(part)
            assert (r["corr"] is None and np.isnan(want)) or r["corr"] == pytest.approx(want, abs=1e-9)
        long = part.loc[part.index.repeat(part["w"])]
        want = long["x"].rank().corr(long["y"].rank())
        assert heavy[g, k]["n"] == part["w"].sum()
        assert (heavy[g, k]["corr"] is None and np.isnan(want)) or heavy[g, k]["corr"] == pytest.approx(want, abs=1e-9)


def test_ranges_of_a_group_follow_its_size(spark, monkeypatch):
    """Many groups share the ranges out, so that runs stay long; a large group keeps many."""
    monkeypatch.setattr(runs, "RANGE_ROWS", 100)
    table = pd.DataFrame({"g": [i % 100 if i % 2 else -1 for i in range(20_000)], "x": [float(i * 7919 % 20_011) for i in range(20_000)]})
    table["y"] = table["x"] % 97
    df = spark.createDataFrame(table)
    seen = []
    plain = runs.sorted_runs
    monkeypatch.setattr(runs, "sorted_runs", lambda groups, schema, p, cuts: seen.append(cuts) or plain(groups, schema, p, cuts))
    got = {r["g"]: r["corr"] for r in spearman(df, ["g"], "x", "y").collect()}
    ranges = sorted(len(ends[0]) + 1 for ends in seen[0].values())
    assert sum(ranges) <= 2 * len(table) / 100 and ranges[-1] >= 50
    for g, part in table.groupby("g"):
        assert got[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-9)


def test_hashed_ranks_equal_pandas(spark, monkeypatch):
    """Ranks that fit in the tasks are hashed, larger ones sorted, with the same results."""
    table = pd.DataFrame({"g": [["a", "b"][i % 3 // 2] for i in range(3000)], "x": [float(i * 37 % 501) for i in range(3000)]})
    table["y"] = table["x"] + [i % 211 for i in range(3000)]
    df = spark.createDataFrame(table)
    for fewest, most in ((0, 1 << 19), (0, 1)):
        monkeypatch.setattr(session, "HASHED", (fewest, most))
        got = {r["g"]: r["corr"] for r in spearman(df, ["g"], "x", "y").collect()}
        for g, part in table.groupby("g"):
            assert got[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-9)
