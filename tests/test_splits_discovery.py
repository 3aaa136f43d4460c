import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, discovery, relations, splits
from panelspark.sources.panel import era_index


def era_frame(spark, n, rows=3):
    return spark.range(n * rows).select(
        F.lpad(((F.col("id") / rows).cast("int") + 1).cast("string"), 4, "0").alias("era"), "id"
    )


def test_split_bounds_examples():
    assert len(splits.split_bounds(150, 5, 10)) == 5
    assert len(splits.split_bounds(83, 5, 10)) == 4
    two = splits.split_bounds(574, 5, 200)
    assert len(two) == 2 and two[0] == (0, 1, 26, 227, 252)
    last = splits.split_bounds(2499, 5, 200)[-1]
    assert last[4] - last[3] + 1 == 23
    with pytest.raises(ValueError):
        splits.split_bounds(20, 5, 10)


def test_gap_and_no_overlap(spark):
    df = era_frame(spark, 150)
    rows = splits.era_cv_splits(df, 5, 10).toPandas()
    for _, fold in rows.groupby("fold"):
        train = fold[fold["role"] == "train"]["era_idx"]
        val = fold[fold["role"] == "val"]["era_idx"]
        assert val.min() - train.max() == 11
        assert not set(train) & set(val)
    assert splits.fold_rows(df, splits.era_cv_splits(df, 5, 10)).count() == len(rows) * 3


def test_era_gap_check(spark):
    a, b = era_frame(spark, 10), era_frame(spark, 130).where("era > '0110'")
    assert splits.check_era_gap(a, b, 100).first()["passed"]
    assert not splits.check_era_gap(a, b, 102).first()["passed"]
    odd = a.withColumn("era", F.lit("2008-01"))
    assert splits.check_era_gap(odd, b, 10_000).first()["passed"]


def test_samples_are_repeatable_and_sized(spark):
    df = era_frame(spark, 5, 200).union(era_frame(spark, 1, 20).withColumn("era", F.lit("0009")))
    one = splits.sample_per_era(df.repartition(1), 50).toPandas()
    many = splits.sample_per_era(df.repartition(8), 50).toPandas()
    assert set(map(tuple, one.values)) == set(map(tuple, many.values))
    assert one.groupby("era").size().to_dict() == {**{f"000{i}": 50 for i in range(1, 6)}, "0009": 20}
    other = splits.sample_per_era(df, 50, seed=7).toPandas()
    assert set(map(tuple, one.values)) != set(map(tuple, other.values))


def test_equal_rows_are_parted_exactly(spark):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [("b", float(i)) for i in range(7)] + [("c", None)] * 1, "era string, x double")
    got = {r["era"]: (r["k"], r["n"]) for r in splits.train_test_split(df, 0.7).groupBy("era").agg(
        F.count_if("is_train").alias("k"), F.count("*").alias("n")).collect()}
    assert got == {"a": (7, 10), "b": (4, 7), "c": (0, 1)}
    assert splits.sample_per_era(df, 4).groupBy("era").count().where("count > 4").count() == 0
    assert splits.sample_per_era(df, 4).count() == 9


def test_train_share_is_exact(spark):
    df = era_frame(spark, 4, 101)
    got = splits.train_test_split(df, 0.7).groupBy("era").agg(F.sum(F.col("is_train").cast("int")).alias("k"))
    assert {r["k"] for r in got.collect()} == {70}


def test_blends():
    three = discovery.blends(3)
    assert three.shape == (8, 3) and np.allclose(three.sum(axis=1), 1)
    assert len(discovery.blends(10)) == 176
    many = discovery.blends(20, 60)
    assert many.shape == (60, 20) and np.allclose(many.sum(axis=1), 1)
    assert np.allclose(many[:20], np.eye(20)) and np.allclose(many[20], 1 / 20)
    assert np.array_equal(many, discovery.blends(20, 60))
    assert np.allclose(discovery.blends(5, 4), np.eye(5)[:4])


@pytest.fixture(scope="module")
def learnable():
    """30 eras of 150 rows: target_a follows the features, target_b is noise."""
    rng = np.random.default_rng(5)
    n = 30 * 150
    x = rng.normal(size=(n, 4))
    frame = pd.DataFrame(x, columns=[f"feature_{i}" for i in range(4)])
    frame["era"] = [f"{i // 150 + 1:04d}" for i in range(n)]
    frame["target_a"] = x @ [1.0, 0.5, 0.0, -0.5] + rng.normal(size=n)
    frame["target_b"] = rng.normal(size=n)
    return frame


FEATURES, TARGETS = [f"feature_{i}" for i in range(4)], ["target_a", "target_b"]


def test_moments_score_equals_direct_correlation(spark, learnable):
    df = spark.createDataFrame(learnable)
    moments = discovery.basis_moments(df, ["feature_0", "feature_1"], TARGETS)
    combos = discovery.blends(2)
    got = {(r["era"], r["combo_id"]): r["corr"] for r in discovery.score_by_era(moments, combos).collect()}
    for era, part in learnable.groupby("era"):
        for i, w in enumerate(combos):
            p = part[["feature_0", "feature_1"]].to_numpy() @ w
            y = part[TARGETS].to_numpy() @ w
            assert got[(era, i)] == pytest.approx(np.corrcoef(p, y)[0, 1], abs=1e-9)


def test_ridge_moments_shape_and_partitions(spark, learnable):
    df = spark.createDataFrame(learnable)
    one = discovery.era_ridge_moments(df.repartition(1), FEATURES, TARGETS).toPandas().sort_values("era")
    many = discovery.era_ridge_moments(df.repartition(8), FEATURES, TARGETS).toPandas().sort_values("era")
    assert len(one) == 30 and set(one["n_test"]) == {45}
    assert np.allclose(np.stack(one["c_py"]), np.stack(many["c_py"]))
    small = discovery.era_ridge_moments(df.where("era = '0001'").limit(99), FEATURES, TARGETS)
    assert small.count() == 0


def test_walk_forward_prefers_the_learnable_target(spark, learnable):
    out = discovery.walk_forward_weights(
        spark.createDataFrame(learnable), FEATURES, TARGETS, history=15, warmup=10
    ).toPandas().sort_values("era")
    w = np.stack(out["weights"])
    assert np.allclose(w.sum(axis=1), 1)
    assert np.allclose(w[:10], 0.5)
    assert (w[12:, 0] > w[12:, 1]).all()


def test_walk_forward_sees_only_the_past(spark, learnable):
    base = spark.createDataFrame(learnable)
    later = base.withColumn(
        "target_a", F.when(F.col("era") >= "0020", -F.col("target_a")).otherwise(F.col("target_a"))
    )
    a, b = (
        discovery.walk_forward_weights(d, FEATURES, TARGETS, 15, 10)
        .where("era <= '0020'").orderBy("era").collect()
        for d in (base, later)
    )
    assert [r["weights"] for r in a] == [r["weights"] for r in b]


def test_short_history_gives_equal_weights(spark, learnable):
    df = spark.createDataFrame(learnable)
    out = discovery.walk_forward_weights(df, FEATURES, TARGETS, history=5, warmup=2).toPandas()
    assert np.allclose(np.stack(out["weights"]), 0.5)  # 750 rows of history


def test_sharpe_of_array_matches_grouped_form(spark):
    from panelspark.operators.metrics import safe_sharpe

    groups = {"a": [0.1, 0.2, -0.05, 0.3], "b": [0.1, 0.1, 0.1], "c": [0.2]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    grouped = {r["g"]: r["sharpe"] for r in safe_sharpe(df, ["g"], "v").collect()}
    arrays = discovery.with_sharpe(df.groupBy("g").agg(F.collect_list("v").alias("c")), "c")
    got = {r["g"]: r for r in arrays.collect()}
    assert got["a"]["sharpe"] == pytest.approx(grouped["a"]) and got["a"]["sign_consistency"] == 0.75
    assert grouped["b"] is None and got["b"]["sharpe"] == 0.0
    assert got["c"]["mean_score"] == 0.0


def test_condition_number_equals_numpy(spark, learnable):
    df = spark.createDataFrame(learnable).withColumn("feature_9", F.lit(1.0))
    for names in (FEATURES, [*FEATURES, "feature_9"]):
        got = {r["era"]: r for r in discovery.condition_number(df, names, ["era"]).collect()}
        for era, part in learnable.groupby("era"):
            with np.errstate(invalid="ignore", divide="ignore"):
                c = np.nan_to_num(np.corrcoef(part.assign(feature_9=1.0)[names], rowvar=False))
            values = np.maximum(np.linalg.eigvalsh(c), 1e-10)
            assert got[era]["min_eigenvalue"] == pytest.approx(values[0], rel=1e-6, abs=1e-9)
            assert got[era]["condition"] == pytest.approx(values[-1] / values[0], rel=1e-5)


def test_moments_of_many_columns(spark, learnable):
    from panelspark.functions.moments import _by_task, second_moments

    df = spark.createDataFrame(learnable)
    few = second_moments(df, FEATURES, ["era"]).toPandas().sort_values("era")
    many = _by_task(df, FEATURES, ["era"]).toPandas().sort_values("era")
    assert list(few["n"]) == list(many["n"])
    assert np.allclose(np.stack(few["mean"]), np.stack(many["mean"]))
    assert np.allclose(np.stack(few["cov"]), np.stack(many["cov"]))


def test_prescreen_ranks_the_learnable_target_first(spark, learnable):
    df = spark.createDataFrame(learnable)
    combos = discovery.blends(2)
    got = {r["combo_id"]: r["score"] for r in discovery.ridge_prescreen(df, FEATURES, TARGETS, combos).collect()}
    assert got[0] > got[2] > got[1]
    two = df.where("era <= '0002'")
    assert {r["score"] for r in discovery.ridge_prescreen(two, FEATURES, TARGETS, combos).collect()} == {0.0}


def test_refine_top_k(spark, learnable):
    df = spark.createDataFrame(learnable).where("era <= '0008'")
    moments = discovery.era_ridge_moments(df, FEATURES, TARGETS)
    scores = discovery.score_combinations(discovery.score_by_era(moments, discovery.blends(2)))
    quick = boosting.Settings(rounds=4, depth=2, step=0.3, row_share=0.8, feature_share=0.5)
    out = discovery.refine_top_k(df, FEATURES, TARGETS, scores, k=2, settings=quick).collect()
    assert len(out) == 2 and all(np.isfinite(r["sharpe"]) for r in out)


def test_early_stopping_takes_the_first_low():
    def turn(*errors):
        line = np.zeros((len(errors), boosting.CHECKS))
        line[:, -1] = errors
        return line

    checks = [turn(9, 1, 5), turn(8, 2, 4), turn(7, 2, 6), turn(7.5, 2, 6), turn(6, 2, 6), turn(9, 1, 3)]
    assert discovery.best_round(checks, 3).tolist() == [4, 1, 1]
    assert discovery.best_round(checks[:1]).tolist() == [0, 0, 0]


def test_features_of_a_blend_are_those_that_correlate_best(spark, learnable):
    df = spark.createDataFrame(learnable).where("era <= '0003'")
    combos = discovery.blends(2)
    got = discovery.blend_features(df, FEATURES, TARGETS, combos, 2)
    part = learnable[learnable["era"] == "0002"]
    for c, w in enumerate(combos):
        corr = part[FEATURES].corrwith(pd.Series(part[TARGETS].to_numpy() @ w, index=part.index)).abs().to_numpy()
        assert got["0002", c] == tuple(np.argsort(-corr, kind="stable")[:2])


def test_no_choice_looks_ahead(spark, learnable):
    """The weights of early eras stay as they are when later rows change."""
    df = spark.createDataFrame(learnable)
    late = df.withColumns({t: F.when(F.col("era") > "0009", -F.col(t)).otherwise(F.col(t)) for t in TARGETS})
    quick = boosting.Settings(rounds=2, depth=2, step=0.3)
    runs = [discovery.walk_forward_weights(d, FEATURES, TARGETS, history=9, warmup=2, mode="hybrid", refine=quick).where(
        "era <= '0010'").orderBy("era").collect() for d in (df, late)]
    assert runs[0] == runs[1] and any(r["combo_id"] is not None for r in runs[0])
    with pytest.raises(ValueError):
        discovery.walk_forward_weights(df, FEATURES, TARGETS, mode="other")


def test_degenerate_eras(spark):
    rows = [("1", 1.0, 2.0), ("1", 1.0, 3.0), ("1", 1.0, 9.0), ("2", 1.0, 5.0), ("2", 1.0, 5.0), ("2", 1.0, 9.0)]
    df = spark.createDataFrame(rows, "era string, target_a double, target_b double")
    assert [r["era"] for r in discovery.degenerate_eras(df, ["target_a", "target_b"]).collect()] == ["2"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    x = rng.random((3000, 8))
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(8)])
    return spark.createDataFrame(frame.assign(y=(x[:, 2] + x[:, 5]) / 2))


def test_mining_does_not_depend_on_partitions(planted):
    names = [f"f{i}" for i in range(8)]
    runs = [
        relations.mine_relationships(planted.repartition(k), names, "y", batches=2).edges.toPandas()
        for k in (1, 8)
    ]
    assert np.allclose(runs[0]["strength"], runs[1]["strength"])
    assert len(runs[0]) == 28 and (runs[0]["strength"] <= 3.0).all()


def whole_index(m):
    """Every other feature as a neighbour, in order, as a dense matrix has them."""
    n = len(m)
    to = np.array([j for i in range(n) for j in range(n) if i != j])
    return relations.Index(np.arange(n + 1) * (n - 1), to, np.array([m[i, j] for i in range(n) for j in range(n) if i != j]))


def test_walk_rules():
    n = 6
    m = whole_index(np.full((n, n), 0.5))
    rows = np.arange(200, dtype=np.uint64) * np.uint64(977)
    x = np.tile(np.linspace(0, 1, n), (200, 1))
    steps, success = relations.walk(x, np.full(200, 9.0), rows, m, 0, 4)
    assert (steps >= 0).all() and (success == 0).all()  # never close, hence full length
    assert all(len(set(r)) == 4 for r in steps)  # no revisits
    steps, success = relations.walk(x, np.full(200, 0.5), rows, m, 0, 4)
    done = steps[:, 1] >= 0
    assert (success[done] >= 0).all() and (success[~done] == 0).all()
    steps, _ = relations.walk(x, np.full(200, 9.0), rows, whole_index(np.full((n, n), 0.05)), 0, 4)
    assert (steps[:, 1:] == -1).all()  # too weak to follow


def _plain_mining(x, y, h, batches, n_paths, max_length, seed=42):
    """Walks one row at a time over a matrix of all pairs, with whole-number arithmetic."""
    mask, n = (1 << 64) - 1, x.shape[1]

    def mix(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & mask
        v = (v ^ v >> 27) * 0x94D049BB133111EB & mask
        return v ^ v >> 31

    def drawn(v, key):
        return mix(v + 0x9E3779B97F4A7C15 * (key + 1) & mask)

    column = [0xD1342543DE82EF95 * (j + 1) & mask for j in range(n)]
    m = [[0.01 + (0.1 - 0.01) * ((mix(drawn(seed, i) + column[j] & mask) >> 11) / 2.0**53) for j in range(n)] for i in range(n)]
    paths, importance = {}, [0.0] * n
    for part in range(batches):
        gain = np.zeros((n, n))
        for row in range(len(y)):
            if h[row] % batches != part:
                continue
            for p in range(n_paths):
                base = drawn(int(h[row]), p)
                path = [base % n]
                total, weight = x[row, path[0]], 1.0
                for step in range(1, max_length):
                    u = drawn(base, step)
                    tried = [(0.0 if j in path else m[path[-1]][j]) + (mix(u + column[j] & mask) >> 11) * (0.01 / 2.0**53) for j in range(n)]
                    j = int(np.argmax(tried))
                    if tried[j] < 0.1:
                        break
                    total += x[row, j] * m[path[-1]][j]
                    weight += m[path[-1]][j]
                    path.append(j)
                    if abs(total / weight - y[row]) < 0.1:
                        break
                success = max(0.0, 1 - 2 * abs(total / weight - y[row])) if len(path) > 1 else 0.0
                if success:
                    for a, b in zip(path, path[1:]):
                        gain[a, b] += 0.001 * success
                        gain[b, a] += 0.001 * success
                    for f in path:
                        importance[f] += 0.05 * success
                    paths[tuple(sorted(path))] = paths.get(tuple(sorted(path)), 0.0) + success
        m = [[min(3.0, m[i][j] + gain[i, j]) for j in range(n)] for i in range(n)]
    return np.array(m) * 0.95, np.array(importance) * 0.95, {k: v * 0.95 for k, v in paths.items() if v * 0.95 >= 0.01}


def test_mining_equals_walking_row_by_row(spark):
    from panelspark.functions.ranking import draw_of

    rng = np.random.default_rng(12)
    x, y = rng.random((500, 6)), rng.random(500)
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y, place=range(500))).repartition(5)
    drawn = {r["place"]: r["h"] for r in df.select("place", draw_of([F.col("place")], 42).alias("h")).collect()}
    strength, importance, paths = _plain_mining(x, y, [drawn[i] for i in range(500)], 3, 4, 4)
    mined = relations.mine_relationships(df, names, "y", n_paths=4, max_length=4, batches=3, keys=["place"])
    edges = mined.edges.collect()
    assert len(edges) == 15
    for r in edges:
        assert r["strength"] == pytest.approx(strength[r["f1_idx"], r["f2_idx"]], abs=1e-9)
    assert {r["idx"]: r["importance"] for r in mined.importance.collect()} == pytest.approx(dict(enumerate(importance)))
    assert {tuple(r["path"]): r["success"] for r in mined.paths.collect()} == pytest.approx(paths)


def test_the_index_holds_every_neighbour_that_can_win():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = np.concatenate([rng.uniform(0.01, 0.1, 40), rng.uniform(0.05, 0.3, 5)])
        kept = set(relations.reachable(s, 7, 4).tolist())
        for _ in range(20):
            visited = [7, *rng.choice(sorted(kept), min(2, len(kept)), replace=False)]
            tried = np.where(np.isin(np.arange(45), visited), 0.0, s) + rng.uniform(0, 0.01, 45)
            if tried.max() >= 0.1:
                assert int(tried.argmax()) in kept


def test_many_features_need_no_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.random((120, 400))
    names = [f"f{i}" for i in range(400)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=x[:, :5].mean(axis=1)))
    mined = relations.mine_relationships(df, names, "y", n_paths=2, max_length=3, batches=2)
    assert mined.edges.count() == 400 * 399 // 2 and mined.importance.count() == 400
    assert 0 < relations.top_relationships(mined.edges, 0.0, 5).count() <= 5


def test_edges_to_relationships(planted):
    names = [f"f{i}" for i in range(8)]
    mined = relations.mine_relationships(planted, names, "y", batches=2)
    top = relations.top_relationships(mined.edges, 0.05, 5).collect()
    assert [r["strength"] for r in top] == sorted((r["strength"] for r in top), reverse=True)
    sane = relations.relationship_sanity(mined.edges, 0.05, 5).first()
    assert sane["passed"] and sane["relationships"] <= 5
    assert mined.importance.count() == 8
    assert mined.paths.where(F.col("success") < 0.01).count() == 0
    assert all(list(r["path"]) == sorted(r["path"]) for r in mined.paths.collect())


def test_era_index_counts(spark):
    got = era_index(era_frame(spark, 4)).orderBy("era").collect()
    assert [r["era_idx"] for r in got] == [1, 2, 3, 4] and {r["n_rows"] for r in got} == {3}


def test_walk_forward_works_out_its_rows_once(spark, monkeypatch):
    from panelspark.session import written

    names = []
    monkeypatch.setattr(discovery, "written", lambda df, name: (names.append(name), written(df, name))[1])
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"era": np.repeat([f"{k:04d}" for k in range(1, 7)], 150), "key": range(900)})
    for c in ("f0", "t0", "t1", "t2", "t3", "t4"):
        rows[c] = rng.normal(size=900)
    quick = boosting.Settings(rounds=1, depth=1)
    found = discovery.walk_forward_weights(
        spark.createDataFrame(rows), ["f0"], [f"t{k}" for k in range(5)], 5, 1, mode="hybrid", refine=quick, keys=["key"])
    assert found.count() == 6 and names.count("clean-rows") == 1
