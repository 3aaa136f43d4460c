import json

import pytest
from pyspark.sql import functions as F

from panelspark.session import bounded, shared_dir, spread
from panelspark.sources import files, panel
from panelspark.streaming import monitor


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


@pytest.mark.parametrize(
    "content,want",
    [
        (["a", "b"], [("features", 0, "a"), ("features", 1, "b")]),
        ({"features": ["a", {"name": "b"}]}, [("features", 0, "a"), ("features", 1, "b")]),
        (
            {"feature_sets": {"small": ["a"], "medium": ["a", "b"]}, "targets": ["t"]},
            [("medium", 0, "a"), ("medium", 1, "b"), ("small", 0, "a")],
        ),
        ({"small": ["a"], "targets": ["t"]}, [("small", 0, "a")]),
    ],
)
def test_feature_set_shapes(spark, tmp_path, content, want):
    out = files.read_feature_sets(spark, write(tmp_path, "f.json", json.dumps(content, indent=2)))
    assert sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize(
    "content",
    [
        {"1": [0.5, 0.5], "2": [1.0, 0.0]},
        {"1": {"weights": [0.5, 0.5]}, "2": {"weights": [1.0, 0.0]}},
        [{"era": "1", "weights": [0.5, 0.5]}, {"era": "2", "weights": [1.0, 0.0]}],
    ],
)
def test_weight_shapes(spark, tmp_path, content):
    out = files.read_weights(spark, write(tmp_path, "w.json", content))
    assert {r["era"]: r["weights"] for r in out.collect()} == {"1": [0.5, 0.5], "2": [1.0, 0.0]}


def test_merge_appends_unseen_names(spark):
    base = spark.createDataFrame([("medium", 0, "a"), ("small", 0, "z")], "feature_set string, pos int, feature string")
    new = spark.createDataFrame([(0, "z"), (1, "a"), (2, "c"), (3, "c")], "pos int, feature string")
    out = files.merge_feature_sets(base, new).where("feature_set = 'medium'")
    assert [(r["pos"], r["feature"]) for r in out.orderBy("pos").collect()] == [(0, "a"), (1, "z"), (2, "c")]
    none = files.merge_feature_sets(base.where("feature_set = 'small'"), new)
    assert none.where("feature_set = 'medium'").agg(F.min("pos")).first()[0] == 0


def test_indicator_and_prices_checks(spark, tmp_path):
    got = files.read_indicator(spark, write(tmp_path, "v.csv", "era,vix\n1,20.5\n2,\n")).collect()
    assert [(r["era"], r["vix"]) for r in got] == [("1", 20.5), ("2", None)]
    with pytest.raises(ValueError):
        files.read_indicator(spark, write(tmp_path, "bad.csv", "era,x\n1,2\n"))
    good = "date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n"
    row = files.read_prices(spark, write(tmp_path, "p.csv", good), "csv").first()
    assert row["Close"] == 1.5 and row["Volume"] == 100 and str(row["date"]) == "2020-01-02"
    with pytest.raises(ValueError):
        files.read_prices(spark, write(tmp_path, "q.csv", "date,Open\n2020-01-02,1\n"), "csv")


def test_scan_cleans_and_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("1", 1.0, 5), ("2", float("nan"), 6), ("3", float("inf"), 7)]
    spark.createDataFrame(rows, "era string, x double, k int").write.parquet(path)
    assert sorted(r["x"] or 0.0 for r in panel.scan_panel(spark, path).collect()) == [0.0, 0.0, 1.0]
    picked = panel.scan_eras(spark, path, ["1", "3"], ["x"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert picked.count() == 2 and "k#" not in plan and "In(era, [1,3])" in plan


def test_panel_round_trip_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("0001", 1.0), ("0002", 2.0)], "era string, x double")
    panel.write_panel(df, path)
    back = spark.read.schema(df.schema).parquet(path).where("era = '0002'")
    assert "PartitionFilters: [isnotnull(era" in back._jdf.queryExecution().executedPlan().toString()
    assert back.first()["x"] == 2.0


def test_sequential_ids_over_partitions(spark, tmp_path):
    df = spark.range(1000).withColumn("prediction", F.col("id") / 10).repartition(7)
    out = panel.sequential_ids(df.select("prediction"), [F.col("prediction").desc()])
    rows = out.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1000))
    assert [r["prediction"] for r in rows] == [i / 10 for i in range(999, -1, -1)]
    path = str(tmp_path / "c")
    panel.write_predictions(df, path, id_col="id")
    assert spark.read.option("header", True).csv(path).columns == ["id", "prediction"]


def test_narrowing_uses_open_ranges(spark):
    df = spark.createDataFrame([(126, 127, 40000, 2**40, 1.5, "s")], "a long, b long, c long, d long, e double, f string")
    assert dict(panel.narrow_types(df).dtypes) == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "string",
    }
    empty = df.where("a < 0")
    assert panel.narrow_types(empty).dtypes == df.dtypes


def test_era_limits(spark):
    df = spark.range(60).select((F.col("id") % 6).cast("string").alias("era"), "id")
    assert {r["era"] for r in panel.restrict_eras(df, first=2).collect()} == {"0", "1"}
    assert {r["era"] for r in panel.restrict_eras(df, last=1).collect()} == {"5"}
    assert {r["era"] for r in panel.restrict_eras(df, within_rows=11).collect()} == {"0", "1"}
    assert {r["era"] for r in panel.restrict_eras(df, within_rows=10).collect()} == {"0"}
    assert panel.limit_rows_per_era(df, 3).groupBy("era").count().where("count <> 3").count() == 0
    assert panel.limit_rows(df, 7, [F.col("id")]).agg(F.max("id")).first()[0] == 6


def test_schema_operators(spark):
    a = spark.createDataFrame([(1, 2, 3, 4)], "feature_a int, feature_b int, feature_c int, target int")
    assert panel.select_by_prefix(a, "feature", 2, tail=True).columns == ["feature_b", "feature_c"]
    b = a.drop("feature_b")
    assert panel.align_features(a, b, None, "target") == ["feature_a", "feature_c"]
    assert panel.align_features(a, b, ["feature_c", "target", "feature_a"], "target") == ["feature_c", "feature_a"]


def test_bounded_and_spread(spark, sf):
    small = bounded(spark.range(10))
    assert small.count() == 10
    big = spark.range(100)
    assert bounded(big, 50) is big
    scan = spark.read.parquet(f"{sf}/orders.parquet")
    assert spread(scan, "o_orderkey").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide


def test_shared_dir_is_under_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark, "x").startswith(f"{root}/x-")


def test_monitor_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(f"2024-01-0{d} {h:02d}:00:00", float((h * 7) % 24), float(h if d != 2 else -((h * 7) % 24)))
            for d in (1, 2, 3) for h in range(24)]
    df = spark.createDataFrame(rows, "t string, prediction double, target double").select(
        F.to_timestamp("t").alias("ts"), "prediction", "target"
    )
    for d in (1, 2, 3):
        df.where(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    monitor.start_monitor(stream, out, checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = {r["window_start"]: r for r in monitor.read_results(spark, out).collect()}
    batch = {r["window_start"]: r for r in monitor.regime_change_batch(df, "ts", "prediction", "target").collect()}
    assert len(batch) == 3 and len(got) == 2  # the last day is still open
    for k, r in got.items():
        assert r["corr"] == pytest.approx(batch[k]["corr"]) and r["n"] == 24
    flags = [r["regime_change"] for _, r in sorted(got.items())]
    assert flags == [False, True]
