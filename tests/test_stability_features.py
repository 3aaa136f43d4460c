import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import features, motifs, pairs, stability

NAMES = [f"feature_{i}" for i in range(10)]


def test_engine_tells_stable_from_flipping(stability_df, stability_frame):
    got = {r["feature"]: r for r in stability.stability_engine(stability_df, NAMES, "y").collect()}
    assert all(got[f"feature_{i}"]["stable"] for i in range(3))
    assert not any(got[f"feature_{i}"]["stable"] for i in range(3, 6))
    assert got["feature_3"]["reason"] == "sign_flip"
    for f in ("feature_0", "feature_4"):
        for regime, part in stability_frame.groupby("regime"):
            want = part[f].rank().corr(part["y"].rank())
            assert got[f]["regime_correlations"][regime] == pytest.approx(want, abs=1e-9)
            assert got[f]["regime_samples"][regime] == len(part)


def test_purge_formula(stability_df):
    got = {r["feature"]: r for r in stability.stability_purge(stability_df, NAMES, "y").collect()}
    r = got["feature_1"]
    c = np.array(list(r["regime_correlations"].values()))
    assert r["stability_score"] == pytest.approx(np.abs(c).mean() * (1 - min(c.std(), 1)))
    assert r["magnitude_drop"] == pytest.approx((np.abs(c).max() - np.abs(c).min()) / np.abs(c).max())
    survivors = [x["feature"] for x in stability.select_survivors(
        stability.stability_purge(stability_df, NAMES, "y")).collect()]
    assert set(survivors[:3]) == {"feature_0", "feature_1", "feature_2"}


def test_small_regimes_and_single_regime(spark, stability_frame):
    part = stability_frame[stability_frame["regime"] == "transition"].head(60)
    few = stability_frame[stability_frame["regime"] == "low_vol_grind"].head(49)
    df = spark.createDataFrame(pd.concat([part, few]))
    purge = stability.stability_purge(df, ["feature_0"], "y").first()
    assert purge["reason"] == "insufficient_regime_data" and not purge["stable"]
    assert purge["n_regimes"] == 1 and purge["stability_score"] == 0.0
    engine = stability.stability_engine(df, ["feature_0"], "y").first()
    assert engine["stable"] and engine["n_regimes"] == 1


def test_constant_feature_has_no_correlation(spark, stability_frame):
    df = spark.createDataFrame(stability_frame.assign(feature_0=1.0))
    assert stability.stability_engine(df, ["feature_0"], "y").first()["reason"] == "no_valid_regime_correlations"
    simple = stability.stability_simple(df, ["feature_0"], "y").first()
    assert not simple["stable"] and simple["sign_flip"] is None


def test_simple_variant(stability_df):
    got = {r["feature"]: r for r in stability.stability_simple(stability_df, NAMES, "y").collect()}
    assert got["feature_0"]["stable"] and got["feature_4"]["sign_flip"]
    kept = [r["feature"] for r in stability.curate_simple(
        stability.stability_simple(stability_df, NAMES, "y")).collect()]
    assert kept[:3] == ["feature_0", "feature_1", "feature_2"] and "feature_3" not in kept


def test_ratios_with_and_without_gaps(spark, stability_frame):
    stable = ["feature_0", "feature_1", "feature_2"]
    whole = spark.createDataFrame(stability_frame)
    got = stability.select_ratios(whole, stable, "y").collect()
    for r in got:
        ratio = stability_frame[r["numerator"]] / (stability_frame[r["denominator"]].abs() + 1e-8)
        want = abs(ratio.rank().corr(stability_frame["y"].rank()))
        assert r["score"] == pytest.approx(want, abs=1e-9)
    gap = stability_frame.assign(n=np.arange(len(stability_frame)))
    df = spark.createDataFrame(gap).withColumns(
        {
            "feature_0": F.when(F.col("n") % 10 != 0, F.col("feature_0")),  # 90% valid
            "feature_2": F.when(F.col("n") % 2 == 0, F.col("feature_2")),  # 50% valid
        }
    )
    got = stability.select_ratios(df, stable, "y").collect()
    assert {r["feature"] for r in got} == {"feature_0_over_feature_1"}
    part = gap[gap["n"] % 10 != 0]
    ratio = part["feature_0"] / (part["feature_1"].abs() + 1e-8)
    assert got[0]["score"] == pytest.approx(abs(ratio.rank().corr(part["y"].rank())), abs=1e-9)
    assert stability.select_ratios(df, ["feature_1"], "y").count() == 0


def test_curation(stability_df):
    verdicts = stability.stability_engine(stability_df, NAMES, "y")
    out = stability.curate_features(verdicts, stability.select_ratios(stability_df, NAMES[:3], "y"))
    kinds = {r["kind"] for r in out.collect()}
    assert kinds == {"stable", "ratio"}
    row = stability.curation_summary(verdicts, 3, 2).first()
    assert row["total_candidates"] == 10 and row["survival_rate"] == pytest.approx(0.5)


def test_pairs_in_order_and_capped():
    assert stability.pairs_of(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert stability.pairs_of(["a", "b", "c"], 2) == [("a", "b"), ("a", "c")]


def test_interactions_keep_their_number(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "feature_aaaa double, feature_bbbb double")
    rel = [
        {"feature1": "feature_aaaa", "feature2": "absent", "strength": 1.0},
        {"feature1": "feature_aaaa", "feature2": "feature_bbbb", "strength": 0.5},
    ]
    row = features.interaction_features(df, rel).first()
    assert row["path_01_aaaaxbbbb"] == pytest.approx(3.0) and "path_00_aaaaxsent" not in row
    yolo = features.yolo_features(df, rel).first()
    assert yolo["path_01_ratio_aaaa_bbbb"] == pytest.approx(1 / 3, rel=1e-5)
    assert yolo["path_01_diff_aaaa_bbbb"] == pytest.approx(-0.5)
    table = spark.createDataFrame(rel)
    assert features.interaction_features(df, table).columns[-1] == "path_01_aaaaxbbbb"


def test_math_features_validity(spark):
    rows = [(1.0, 2.0, None if i < 3 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "f_a double, f_b double, f_c double")
    names = features.math_features(df, ["f_a", "f_b", "f_c"]).columns
    assert "ratio_a_b_00" in names and "diff_a_c_01" in names
    assert "ratio_a_c_01" not in names  # 70% valid


def test_neutralize(stability_df, stability_frame):
    out = features.neutralize(stability_df.withColumn("feature_9", F.lit(1.0)), ["feature_0", "feature_9"], "y")
    assert "feature_9_neutralized" not in out.columns
    rho = stability_frame["feature_0"].rank().corr(stability_frame["y"].rank())
    r = out.first()
    assert r["feature_0_neutralized"] == pytest.approx(r["feature_0"] - 0.5 * rho * r["y"])


def test_impute(spark):
    rows = [("1", 1.0, None), ("1", 3.0, None), ("1", None, None), ("2", 5.0, 1.0), ("2", float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "era string, a double, b double")
    zero = features.impute_zero(df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in zero) == [0.0, 0.0, 1.0, 3.0, 5.0]
    med = features.impute_median(df.where("a is null or a < 100"), ["a", "b"]).collect()
    assert sorted(r["a"] for r in med) == [1.0, 2.0, 3.0, 5.0]
    assert sorted(r["b"] for r in med) == [0.0, 0.0, 0.0, 1.0]


def test_k_centers_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    got = [r["id"] for r in features.k_center_prototypes(df, "v", "id", 5, start=7).orderBy("pos").collect()]
    want, d = [7], np.linalg.norm(pts - pts[7], axis=1)
    for _ in range(4):
        want.append(int(np.argmax(d)))
        d = np.minimum(d, np.linalg.norm(pts - pts[want[-1]], axis=1))
    assert got == want


def test_k_centers_stop_at_duplicates(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id long, v array<double>")
    assert features.k_center_prototypes(df, "v", "id", 5, start=0).count() == 2


def test_zpos(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = features.zpos_binarize(df, ["a", "b"]).orderBy("a").collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(False, False), (True, False)]
    arr = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    assert sorted(r["bits"] for r in features.zpos_array(arr, "v").collect()) == [[False, False], [True, False]]


def test_motifs_against_a_dictionary(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(400, 4)).astype(float)
    y = rng.normal(size=400)
    y[:5] = np.nan
    names = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y, era="1"))
    stats = {}
    for row, target in zip(x, y):
        if not np.isfinite(target):
            continue
        for n in (2, 3):
            for i in range(4 - n + 1):
                s = stats.setdefault((i, tuple(row[i : i + n])), [0.0, 0])
                s[0] += target
                s[1] += 1
    mined = motifs.motif_mine(df, names, "y", [3, 2, 2])
    got = {(r["start"], tuple(r["motif_values"])): (r["count"], r["score"]) for r in mined.collect()}
    assert set(got) == set(stats)
    for key, (total, n) in stats.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(total / n * np.log1p(n))
    top = motifs.top_motifs(mined, names, 5, 10).collect()
    assert [r["score"] for r in top] == sorted((r["score"] for r in top), reverse=True)
    flagged = motifs.motif_flags(df, motifs.top_motifs(mined, names, 5, 3))
    assert sum(c.startswith("motif_") for c in flagged.columns) == 3
    first = top[0]
    name = next(c for c in flagged.columns if c.startswith("motif_00"))
    cond = [df[n] == v for n, v in zip(first["motif_features"], first["motif_values"])]
    want = df
    for c in cond:
        want = want.where(c)
    assert flagged.where(F.col(name) == 1).count() == want.count()
    with pytest.raises(ValueError):
        motifs.motif_mine(df, names, "y", [])
    assert motifs.motif_mine(df, names, "y", [2], eras=["2"]).count() == 0


def _plain_ratio_scores(x, y, share=0.8):
    """{(i, j): |rank correlation|} of the ratios over complete rows, by pandas."""
    found = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            v = pd.Series(x[:, i] / (np.abs(x[:, j]) + 1e-8))
            ok = v.notna()
            if ok.mean() >= share:
                found[i, j] = v[ok].rank().corr(pd.Series(y)[ok].rank())
    return found


@pytest.mark.parametrize("bucket_rows", [1 << 20, 60])
@pytest.mark.parametrize("gaps", [False, True])
def test_ratios_of_all_pairs_against_pandas(spark, monkeypatch, bucket_rows, gaps):
    """Ties, masses of equal ratios and gaps; with small buckets every pair is cut into ranges."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(500, 9)), 1)
    x[:, 3] = 0.0
    x[:200, 4] = x[:200, 5] = 1.0
    if gaps:
        x[rng.random(500) < 0.1, 1] = np.nan
        x[rng.random(500) < 0.3, 2] = np.nan
        x[rng.random(500) < 0.05, 8] = np.nan
    y = np.round(x[:, 0] + rng.normal(size=500), 1)
    rows = [(*[None if np.isnan(v) else float(v) for v in line], float(t)) for line, t in zip(x, y)]
    names = [f"f{i}" for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(4)
    monkeypatch.setattr(pairs, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(pairs.whole_ratio_correlations, "__defaults__", (bucket_rows,))
    got = {(r["i"], r["j"]): r["corr"] for r in pairs.ratio_correlations(df, names, "y", 1e-8, 0.8).collect()}
    want = _plain_ratio_scores(x, y)
    assert set(got) == set(want)
    for key, corr in want.items():
        assert (got[key] is None and np.isnan(corr)) or got[key] == pytest.approx(corr, abs=1e-9), key


def test_pair_numbers_and_empty_inputs(spark):
    rows = pairs.pair_table(spark, 5).orderBy("pair").collect()
    want = [(k, i, j) for k, (i, j) in enumerate((i, j) for i in range(5) for j in range(i + 1, 5))]
    assert [tuple(r) for r in rows] == want
    df = spark.createDataFrame([], "a double, b double, y double")
    assert pairs.pair_table(spark, 1).count() == pairs.pair_table(spark, 0).count() == 0
    assert stability.select_ratios(df, ["a", "b"], "y").count() == 0
    assert [r["valid_share"] for r in features.feature_pairs(df, ["a", "b"]).collect()] == [None]


def test_missing_targets_leave_no_score(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 3.0), (4.0, 3.0, 1.0)], "a double, b double, y double")
    assert [r["corr"] for r in pairs.ratio_correlations(df, ["a", "b"], "y", 1e-8).collect()] == [None]


def test_many_pairs_take_no_more_plan(spark):
    """The plan's size follows the features, not their pairs."""
    def size(p):
        df = spark.range(200).select(*[(F.rand(i) + F.col("id")).alias(f"f{i}") for i in range(p)], F.rand(99).alias("y"))
        out = stability.select_ratios(df, [f"f{i}" for i in range(p)], "y")
        return len(out._jdf.queryExecution().analyzed().toString())

    small, large = size(10), size(80)
    assert large < 12 * small


def test_math_pairs_equal_the_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *[None if rng.random() < 0.15 * k else float(v) for k, v in enumerate(rng.normal(size=4))]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, f_a double, f_b double, f_c double, f_d double")
    base = ["f_a", "f_b", "f_c", "f_d"]
    wide = {r["id"]: r for r in features.math_features(df, base).collect()}
    ratios = [c for c in features.math_features(df, base).columns if c.startswith("ratio")]
    assert 0 < len(ratios) < 6
    for r in features.math_pairs(df, ["id"], base).collect():
        a, b = pairs_in_order(base)[r["pair"]]
        name = f"{a[-1]}_{b[-1]}_{r['pair']:02d}"
        assert r["diff"] == wide[r["id"]][f"diff_{name}"]
        assert r["ratio"] == (wide[r["id"]][f"ratio_{name}"] if f"ratio_{name}" in ratios else None)


def pairs_in_order(names):
    return stability.pairs_of(names)
