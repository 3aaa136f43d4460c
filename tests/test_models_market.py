import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, market, metrics, models, quality
from panelspark.operators.splits import era_cv_splits
from panelspark.session import uncounted, written


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 3000
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    era = np.arange(n) // 25 + 1
    return pd.DataFrame(
        {
            "era": [f"{e:04d}" for e in era],
            "x1": x1,
            "x2": x2,
            "vix": np.array([10.0, 20.0, 30.0])[np.arange(n) // 25 % 3],
            "target": 0.5 * x1 - 0.2 * x2 + 0.3 + 0.1 * rng.normal(size=n),
        }
    )


@pytest.fixture(scope="module")
def df(spark, frame):
    regime = F.when(F.col("vix") > 25, "crisis").when(F.col("vix") < 15, "grind").otherwise("transition")
    return spark.createDataFrame(frame).withColumn("regime", regime).cache()


def test_linear_fit_equals_lstsq(df, frame):
    out = models.linear_fit(df.withColumn("g", F.lit("all")), ["x1", "x2"], "target", ["g"]).first()
    a = np.c_[np.ones(len(frame)), frame[["x1", "x2"]]]
    want = np.linalg.lstsq(a, frame["target"], rcond=None)[0]
    assert [out["intercept"], *out["coef"]] == pytest.approx(list(want))
    by = models.fit_linear_by_regime(df, ["x1", "x2"], "target")
    assert {r["regime"] for r in by.collect()} == {"crisis", "grind", "transition"}


def test_linear_fit_survives_collinear_features(df):
    twice = df.withColumn("x3", F.col("x1") * 2).withColumn("g", F.lit(1))
    model = models.linear_fit(twice, ["x1", "x3"], "target", ["g"])
    scored = models.linear_predict(twice, model, ["x1", "x3"], ["g"])
    assert scored.select(F.corr("prediction", "x1")).first()[0] == pytest.approx(1.0)


def test_time_machine(df):
    train, test = df.where("era <= '0030'"), df.where("era >= '0090'")
    r = models.time_machine_test(train, test, ["x1", "x2"], "target", min_gap=50).first()
    assert r["honesty"] > 0.9 and r["drop"] < 0.1
    with pytest.raises(ValueError):
        models.time_machine_test(train, test, ["x1"], "target", min_gap=100)
    flat = test.withColumn("target", F.lit(1.0))
    r = models.time_machine_test(train, flat, ["x1"], "target", min_gap=50).first()
    assert r["test_correlation"] is None and r["honesty"] == 0.0 and np.isinf(r["drop"])
    turned = test.withColumn("target", -F.col("target"))
    r = models.time_machine_test(train, turned, ["x1"], "target", min_gap=50).first()
    assert r["honesty"] == 0.0 and r["drop"] > 1


def test_validate_folds_against_numpy(df, frame):
    splits = era_cv_splits(df, 3, 10)
    out = models.validate_folds(df, splits, ["x1", "x2"], "target")
    got = {(r["fold"], r["metric"]): r["value"] for r in out["metrics"].collect()}
    table = splits.toPandas()
    for fold, part in table.groupby("fold"):
        eras = {role: set(p["era"]) for role, p in part.groupby("role")}
        train, val = (frame[frame["era"].isin(eras[r])] for r in ("train", "val"))
        a = np.c_[np.ones(len(train)), train[["x1", "x2"]]]
        b = np.linalg.lstsq(a, train["target"], rcond=None)[0]
        pred = pd.Series(np.c_[np.ones(len(val)), val[["x1", "x2"]]] @ b, index=val.index)
        assert got[(fold, "overall_correlation")] == pytest.approx(pred.rank().corr(val["target"].rank()))
        corrs = [pred[p.index].rank().corr(p["target"].rank()) for _, p in val.groupby("era")]
        assert got[(fold, "sharpe_ratio")] == pytest.approx(np.mean(corrs) / np.std(corrs, ddof=1))
        assert got[(fold, "n_eras")] == len(corrs)
    assert {r["metric"] for r in out["summary"].collect()} >= {"corr_crisis", "corr_grind", "mean_correlation"}
    assert out["honesty"].first()["honest"]


def test_cross_validate_keeps_the_minimum_gap(df):
    with pytest.raises(ValueError):
        models.cross_validate(df, ["x1"], "target", 5, gap=5)  # 120 eras, gap becomes 200


def test_sharpe_rules(spark):
    df = spark.createDataFrame([(v,) for v in (0.05, 0.03, 0.07, -0.02, 0.04)], "corr double")
    r = metrics.realistic_sharpe(df, [], "corr").first()
    values = np.array([0.05, 0.03, 0.07, -0.02, 0.04])
    assert r["sharpe_ratio"] == pytest.approx(values.mean() / values.std(ddof=1))
    assert r["sharpe_with_tc"] <= r["sharpe_ratio"]
    empty = metrics.realistic_sharpe(df.where("corr > 1"), [], "corr").first()
    assert empty["sharpe_ratio"] == 0 and empty["sharpe_with_tc"] == 0 and empty["tc_impact"] == 0
    same = metrics.realistic_sharpe(spark.createDataFrame([(0.1,), (0.1,)], "corr double"), [], "corr").first()
    assert same["sharpe_ratio"] == 0
    low = metrics.realistic_sharpe(df.withColumn("corr", -F.col("corr")), [], "corr").first()
    assert low["sharpe_with_tc"] == 0.0


def test_era_sanity_cases(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", 1.0), ("c", 1.0), ("c", 1.0), ("c", 5.0)]
    got = {r["g"]: r for r in metrics.era_sanity(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["a"]["mad"] == 1.0 and not got["a"]["is_constant"] and got["a"]["n_unique"] == 3
    assert got["b"]["std"] == 0.0 and got["b"]["is_constant"]
    assert got["c"]["mad"] == 0.0 and got["c"]["is_constant"]  # most values equal


def test_ensemble_and_regime_models(df):
    train, test = df.where("era <= '0060'"), df.where("era > '0080'")
    quick = boosting.Settings(rounds=6, depth=3, step=0.3)
    fitted = models.train_ensemble(train, ["x1", "x2"], "target", [1, 2], quick)
    scored = models.predict_ensemble(test, fitted, ["x1", "x2"])
    assert scored.columns == [*test.columns, "prediction"]
    assert scored.select(F.corr("prediction", "target")).first()[0] > 0.7
    with pytest.raises(ValueError):
        models.predict_ensemble(test.drop("x1"), fitted, ["x1", "x2"])
    small = train.where("vix < 25 or era = '0003'")  # one era of 25 crisis rows
    by = models.train_by_regime(small, ["x1", "x2"], "target", quick)
    assert set(by.of_segment()) == {"grind", "transition"}
    rows = test.withColumn("vix", F.when(F.col("era") != "0081", F.col("vix")))
    out = models.predict_by_regime(rows, by, ["x1", "x2"])
    assert out.count() == rows.count()
    zero = out.where("vix is null or vix > 25")
    assert zero.where("prediction <> 0").count() == 0 and zero.count() > 0
    evaluated = {r["metric"]: r["value"] for r in metrics.evaluate_predictions(out).collect()}
    assert evaluated["corr_grind"] > 0.5 and evaluated["n_eras"] > 0
    with pytest.raises(ValueError):
        models.train_by_regime(df.drop("vix"), ["x1"], "target")


def _plain_boost(x, y, goes, settings, models):
    """Predictions by trees grown one at a time from all rows, every value a bin of its own."""
    values = [np.unique(x[:, k]) for k in range(x.shape[1])]
    base = y[goes].mean()
    f = np.full(len(y), base)
    for _ in range(settings.rounds):
        left = [(np.arange(len(y)), 0)]
        step = np.zeros(len(y))
        while left:
            rows, depth = left.pop()
            teach = rows[goes[rows]]
            r = (y - f)[teach]
            step[rows] = settings.step * r.mean()
            best = None
            for k in range(x.shape[1]) if depth < settings.depth else ():
                for v in values[k][:-1]:
                    low = x[teach, k] <= v
                    n = low.sum()
                    if settings.min_rows <= n <= len(teach) - settings.min_rows:
                        gain = r[low].sum() ** 2 / n + r[~low].sum() ** 2 / (len(teach) - n) - r.sum() ** 2 / len(teach)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, k, v)
            if best and best[0] > 1e-12:
                low = x[rows, best[1]] <= best[2]
                left += [(rows[low], depth + 1), (rows[~low], depth + 1)]
        f = f + step
    return f


@pytest.mark.parametrize("state_rounds, block, held, direct", [(10, 64, 1 << 22, 1 << 26), (2, 1, 50, 0)])
def test_boosted_trees_against_plain_ones(spark, monkeypatch, state_rounds, block, held, direct):
    """Two segments and two targets at once; with small blocks, hand-ons and rewritten predictions."""
    for name, value in (("STATE_ROUNDS", state_rounds), ("BLOCK", block), ("HELD", held), ("DIRECT", direct)):
        monkeypatch.setattr(boosting, name, value)
    rng = np.random.default_rng(4)
    n = 600
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    y = np.stack([x[:, 0] * (x[:, 1] > 5) + rng.normal(size=n), x[:, 2] + rng.normal(size=n)], axis=1)
    seg, goes = rng.integers(0, 3, n), rng.random(n) < 0.7
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(seg=seg, goes=goes, y0=y[:, 0], y1=y[:, 1], place=range(n))
    df = spark.createDataFrame(frame).repartition(5)
    settings = boosting.Settings(rounds=5, depth=3, step=0.3, row_share=1.0, feature_share=1.0, min_rows=7)
    keys = [boosting.ModelKey(0, (1.0, 0.0)), boosting.ModelKey(1, (0.5, 0.5)), boosting.ModelKey(1, (0.0, 1.0))]
    fitted = boosting.boost(df, ["a", "b", "c"], ["y0", "y1"], keys, "seg", settings, "goes")
    got = boosting.predict(df, fitted, F.col("seg"), missing=-1.0).toPandas().sort_values("place")["prediction"].to_numpy()
    want = np.full(n, -1.0)
    plain = {}
    for s in (0, 1):
        here = seg == s
        mine = [k for k in keys if k.segment == s]
        plain.update({k: _plain_boost(x[here], y[here] @ np.array(k.weights), goes[here], settings, mine) for k in mine})
        want[here] = np.mean([plain[k] for k in mine], axis=0)
    assert np.allclose(got, want)
    assert len(fitted.checks) == settings.rounds + 1
    for m, key in enumerate(keys):
        out = ~goes[seg == key.segment]
        error = ((y[seg == key.segment] @ np.array(key.weights) - plain[key])[out] ** 2).sum()
        assert fitted.checks[-1][m][-1] == pytest.approx(error) and fitted.checks[-1][m][0] == out.sum()


def _sampled(spark, n=3000):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"a": rng.integers(0, 9, n) / 2, "b": rng.normal(size=n), "seg": np.array(["u", "v", None])[np.arange(n) % 3]})
    # a hot cell: a third of the rows share their bins
    data.loc[data.index < n // 3, ["a", "b"]] = 1.0
    data["y"], data["z"] = data["a"] * data["b"] + rng.normal(size=n), data["b"] + rng.normal(size=n)
    return spark.createDataFrame(data).repartition(3)


SAMPLED = boosting.Settings(rounds=7, depth=4, step=0.3, row_share=0.7, feature_share=0.5, min_rows=5)


def test_trees_from_cells_equal_trees_from_passes_over_rows(spark, monkeypatch):
    df = _sampled(spark)
    keys = [boosting.ModelKey("v", (1.0, 0.0)), boosting.ModelKey("u", (0.5, 0.5), 1), boosting.ModelKey("u", (1.0, 0.0), 1, (1,)),
            boosting.ModelKey("w", (1.0, 0.0))]
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 100)
    fitted, scored = [], []
    for cells, rows, looked_up in ((1 << 24, 1 << 19, 1 << 21), (1 << 24, 200, 0), (0, 1 << 19, 0)):
        for name, value in (("CELLS", cells), ("TASK_ROWS", rows), ("LOOKED_UP", looked_up)):
            monkeypatch.setattr(boosting, name, value)
        fitted.append(boosting.boost(df, ["a", "b"], ["y", "z"], keys, "seg", SAMPLED))
        scored.append(boosting.predict(df, fitted[-1], F.col("seg"), missing=-7.0).select("a", "b", "seg", "y", "prediction").toPandas().sort_values(
            ["y", "a", "b"])["prediction"].to_numpy())
    for other in (1, 2):
        for name in ("feature", "bin", "value"):
            for one, two in zip(getattr(fitted[0], name), getattr(fitted[other], name), strict=True):
                np.testing.assert_allclose(one, two, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(scored[0], scored[other], rtol=1e-9)
    assert max((f >= 0).sum() for f in fitted[0].feature) > 10 and (scored[0] == -7.0).sum() == 1000


def test_jobs_of_boosting_do_not_grow_with_rounds(spark, monkeypatch):
    """Without held-out rows, a round is no pass over the rows."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for rounds in (1, 12):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        settings = boosting.Settings(rounds=rounds, depth=3, row_share=0.7)
        boosting.boost(_sampled(spark, 300), ["a", "b"], ["y"], [boosting.ModelKey("u", (1.0,))], "seg", settings)
        counts.append(len(tracker.getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0


def test_regime_models_work_out_their_rows_once(spark, df):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        counted.add(1)
        return x

    rows = df.where("era <= '0010'")
    n = rows.count()
    models.train_by_regime(rows.withColumn("target", seen(F.col("target"))), ["x1", "x2"], "target", boosting.Settings(rounds=1, depth=1))
    assert counted.value <= 2 * n  # for the filter and for the columns that are written


def test_places_of_rows_equal_a_walk_down_the_tree():
    rng = np.random.default_rng(5)
    depth, nodes = 5, 2**6 - 1
    feature = rng.integers(-1, 3, nodes)
    feature[0], feature[2**depth - 1:] = 1, -1
    for node in range(1, nodes):
        feature[node] = feature[node] if feature[(node - 1) // 2] >= 0 else -1
    bin_, value = rng.integers(0, 9, nodes).astype(np.uint8), rng.normal(size=nodes)
    x = rng.integers(0, 10, (3, 400)).astype(np.uint8)

    def walked(row):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + 1 + (x[feature[node], row] > bin_[node])
        return node

    ends = np.array([walked(k) for k in range(400)])
    assert (boosting._leaf_values(feature, bin_, value, x, depth) == value[ends]).all()
    level = boosting.MASKED + 1
    alive = boosting._grown_nodes(feature, level)
    places = boosting._places(feature, bin_, x, level)
    for k in range(400):
        node = 0
        for _ in range(level):
            node = 2 * node + 1 + (x[feature[node], k] > bin_[node]) if feature[node] >= 0 else -1
            if node < 0:
                break
        assert alive[places[k]] == (node >= 0) and (node < 0 or places[k] == node - 2**level + 1)


def test_rows_are_worked_out_once_and_kept_in_chunks(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(boosting, "written", lambda df, name: (names.append(df), written(df, name))[1])
    df = spark.range(500).selectExpr("'s' seg", "double(id % 7) a", "double(id % 5) y")
    boosting.boost(df, ["a"], ["y"], [boosting.ModelKey("s", (1.0,))], "seg", boosting.Settings(rounds=1, depth=1))
    cells, state = names
    assert cells.count() == 500 and state.count() < 50


def test_boosting_draws_rows_and_features_by_seed(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 6))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")).assign(y=x[:, 0] + x[:, 3], seg="s"))
    settings = boosting.Settings(rounds=3, depth=2, step=0.5, row_share=0.5, feature_share=0.5, bins=16)
    keys = [boosting.ModelKey("s", (1.0,), seed) for seed in (1, 2)] + [boosting.ModelKey("s", (1.0,), 1, (1, 2))]
    runs = [boosting.boost(df.repartition(k), list("abcdef"), ["y"], keys, "seg", settings) for k in (4, 4)]
    assert all(np.array_equal(a, b) for a, b in zip(runs[0].feature, runs[1].feature))
    used = [set(np.concatenate([f[m] for f in runs[0].feature])) - {-1} for m in range(3)]
    assert used[2] <= {1, 2} and not np.array_equal(runs[0].value[0][0], runs[0].value[0][1])
    assert all(len(c) <= 15 for c in runs[0].cuts)
    assert boosting.boost(df, ["a"], ["y"], [], "seg", settings).models == []
    flat = boosting.boost(df.withColumn("y", F.lit(2.0)), ["a"], ["y"], keys[:1], "seg", settings)
    got = boosting.predict(df, flat, F.col("seg")).agg(F.min("prediction"), F.max("prediction")).first()
    assert got[0] == pytest.approx(2.0) and got[1] == pytest.approx(2.0)


def test_rows_of_few_segments_are_neither_sorted_nor_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"a": rng.integers(0, 9, 900) / 2, "b": rng.normal(size=900), "seg": np.array(["u", "v", None])[np.arange(900) % 3]})
    df = spark.createDataFrame(data.assign(y=data["a"] + rng.normal(size=900))).repartition(spark.sparkContext.defaultParallelism)
    keys = [boosting.ModelKey("v", (1.0,)), boosting.ModelKey("u", (1.0,), 1)]
    settings = boosting.Settings(rounds=3, depth=2, step=0.5, row_share=1.0, feature_share=1.0)
    plans, limits, fitted = [], [], []
    real, key = boosting.written, "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    monkeypatch.setattr(boosting, "written", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), limits.append(spark.conf.get(key)), real(df, name))[2])
    for few in (8, 0):
        monkeypatch.setattr(boosting, "FEW_SEGMENTS", few)
        fitted.append(boosting.boost(df, ["a", "b"], ["y"], keys, "seg", settings))
    assert ["rangepartitioning" in p for p in plans] == [False, False, False, True]
    assert "Sort [" not in plans[1] and limits[1] == str(2**31 - 1) and spark.conf.get(key) == limits[0] == was
    for name in ("feature", "bin", "value"):
        for one, other in zip(getattr(fitted[0], name), getattr(fitted[1], name)):
            np.testing.assert_allclose(one, other, rtol=1e-9, atol=1e-12)
    scored = [boosting.predict(df, f, F.col("seg")).where("seg IS NOT NULL").agg(F.sum("prediction"), F.count("*")).first() for f in fitted]
    assert scored[0][0] == pytest.approx(scored[1][0]) and scored[0][1] == 600


def test_bytes_are_counted_where_a_batch_could_pass_the_limit(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was, rows = spark.conf.get(key), int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    with uncounted(spark, (64 << 20) // rows // 9 + 1):
        assert spark.conf.get(key) == was
    with pytest.raises(KeyError), uncounted(spark, 5):
        assert spark.conf.get(key) == str(2**31 - 1)
        raise KeyError
    assert spark.conf.get(key) == was


def test_stump_queries_work_out_their_panel_once(spark, sf, monkeypatch):
    from panelspark.plans import model_queries

    rows = []
    monkeypatch.setattr(model_queries, "written", lambda df, name: (rows.append(df.columns), written(df, name))[1])
    scored = model_queries.train_ensemble_stumps(spark, sf)
    assert rows == [["era", "feature_discount", "feature_quantity", "target_net"]]
    assert all("panel-rows-" in f for f in scored.inputFiles())


def test_compare_models(spark):
    valid = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, target double")
    good = valid.select("id", F.col("target").alias("prediction")).where("id < 8")
    bad = valid.select("id", (-F.col("target")).alias("prediction"))
    got = {r["model"]: r for r in models.compare_models({"good": good, "bad": bad}, valid).collect()}
    assert got["good"]["corr"] == pytest.approx(1) and got["good"]["n"] == 8
    assert got["bad"]["corr"] == pytest.approx(-1)


@pytest.fixture(scope="module")
def prices(spark):
    rows = []
    for t, closes in {"^VIX": [10, 20, 10], "SPY": [100, 100, 100, 110]}.items():
        rows += [(t, f"2020-01-0{i + 1}", float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, d string, Close double").select(
        "ticker", F.to_date("d").alias("date"), "Close"
    )


def test_ticker_features(spark, prices):
    days = market.ordinal_era_map(prices)
    assert [r["era"] for r in days.orderBy("date").collect()] == ["0001", "0002", "0003", "0004"]
    wanted = spark.createDataFrame([("1",), ("2",), ("4",), ("9",)], "era string")
    out = {r["era"]: r for r in market.era_ticker_features(prices, days, wanted, "ensemble_ret", "Close").collect()}
    assert set(out) == {"0001", "0002", "0004", "0009"}
    assert out["0002"]["^VIX_ret"] == pytest.approx(1.0) and out["0002"]["ensemble_ret"] == pytest.approx(0.5)
    assert out["0004"]["SPY_ret"] == pytest.approx(0.1) and out["0004"]["^VIX_ret"] is None
    assert out["0009"]["SPY_ret"] is None
    close = market.era_ticker_features(prices, days, None, "close", "Close")
    assert market.pick_indicator(close).where("era = '0002'").first()["vix"] == 20.0
    z = market.era_ticker_features(prices, days, None, "zscore", "Close").where("era = '0004'").first()
    r = pd.Series([0.0, 0.0, 0.1])
    assert z["SPY_zret"] == pytest.approx((0.1 - r.mean()) / r.std(ddof=1))
    with pytest.raises(ValueError):
        market.era_ticker_features(prices, days, None, "other")


def test_custom_map_keeps_the_first_day(spark, prices, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("era,date\n1,2020-01-01\n1,2020-01-02\n1,2020-01-02\n2,2020-01-03\n")
    days = market.custom_era_map(spark, str(path))
    assert days.count() == 3
    out = {r["era"]: r["SPY_close"] for r in market.era_ticker_features(prices, days, None, "close", "Close").collect()}
    assert out == {"0001": 100.0, "0002": 100.0}


def test_quality(spark):
    df = spark.range(400).select(
        ((F.col("id") / 40).cast("int") + 1).alias("era"),
        F.rand(1).alias("feature_a"),
        F.rand(2).alias("target_a"),
    )
    got = {r["check"]: r["passed"] for r in quality.panel_quality(df, ["feature_a"], ["target_a"], "target_a").collect()}
    assert got["eras_sequential"] and got["min_rows_per_era"] and got["nulls_target_a"] and got["std_target_a"]
    worse = df.where("era <> 3").withColumn("target_a", F.col("feature_a") * 100)
    got = {r["check"]: r["passed"] for r in quality.panel_quality(worse, ["feature_a"], ["target_a"], "target_a").collect()}
    assert not got["eras_sequential"] and not got["max_abs_correlation"] and not got["max_target_a"]
