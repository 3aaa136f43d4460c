"""Walk-forward discovery of target weights."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.functions.correlation import pearson_of, to_long
from panelspark.functions.moments import schema_of, second_moments
from panelspark.functions.ranking import exact_median, median_and_mad
from panelspark.operators import boosting
from panelspark.operators.metrics import CONSTANT_TOLERANCE, MAD_TO_STD, SHARPE_EPS
from panelspark.operators.splits import train_test_split
from panelspark.session import bounded, written
from panelspark.sources.panel import era_index

# Weights of enumerated blends, sizes of drawn blends, limits of the search.
PAIR_WEIGHTS, TRIPLE_WEIGHTS = (0.6, 0.4), (0.4, 0.35, 0.25)
DRAWN_SIZES, DIRICHLET = (3, 5, 8, 12, 15), 0.5
FOCUS_RANGE = (0.5, 0.8)
MAX_ENUMERATED_TARGETS, MAX_COMBINATIONS = 10, 200
MIN_ERA_ROWS, MIN_HISTORY_ROWS = 100, 1000
TRAIN_SHARE = 0.7
BAD_CONDITION, BAD_EIGENVALUE, EIGENVALUE_FLOOR = 1e12, 1e-6, 1e-10
TOP_FEATURES, REFINE_TOP = 80, 3
KEEP_AT_LEAST, KEEP_SHARE = 15, 5
SCREEN_ABOVE, MIN_SCREEN_ERAS = 10, 3
REFINE = boosting.Settings(rounds=20, depth=3, step=0.2, row_share=0.8, feature_share=0.5)
PATIENCE, FLAT = 5, 1e-8
MODES = ("linear", "hybrid", "boosted")


def blends(n_targets: int, limit: int | None = None, seed: int = 42) -> np.ndarray:
    """Candidate weight vectors: singles, equal, then enumerated or drawn blends.

    All singles and the equal blend are always there, unless the caller's ``limit`` keeps only
    the first blends; more are drawn up to ``limit``, or MAX_COMBINATIONS.
    """
    def vector(places, weights):
        v = np.zeros(n_targets)
        v[list(places)] = weights
        return v

    found = [vector([i], [1.0]) for i in range(n_targets)]
    found.append(np.full(n_targets, 1.0 / n_targets))
    if n_targets <= MAX_ENUMERATED_TARGETS:
        for weights in (PAIR_WEIGHTS, TRIPLE_WEIGHTS):
            found += [vector(c, weights) for c in combinations(range(n_targets), len(weights))]
    else:
        rng = np.random.default_rng(seed)
        room = max(0, (limit or MAX_COMBINATIONS) - len(found))
        plan = [s for s in DRAWN_SIZES if s <= n_targets for _ in range(min(10, room // 4))]
        for size in plan:
            places = rng.choice(n_targets, size, replace=False)
            found.append(vector(places, rng.dirichlet(np.full(size, DIRICHLET))))
        for _ in range(min(20, room // 3)):
            size = int(rng.integers(2, min(6, n_targets + 1)))
            lead = rng.uniform(*FOCUS_RANGE)
            rest = rng.dirichlet(np.full(size - 1, DIRICHLET)) * (1.0 - lead)
            places = rng.choice(n_targets, size, replace=False)
            found.append(vector(places, np.concatenate([[lead], rest])))
    return np.array(found[:limit])


def target_combinations(
    spark: SparkSession, n_targets: int, limit: int | None = None, seed: int = 42
) -> DataFrame:
    rows = [(i, [float(x) for x in w]) for i, w in enumerate(blends(n_targets, limit, seed))]
    return spark.createDataFrame(rows, "combo_id int, weights array<double>")


def degenerate_eras(
    df: DataFrame, targets: list[str], tol: float = CONSTANT_TOLERANCE, era: str = "era"
) -> DataFrame:
    """Eras in which the MAD of every target is below ``tol``."""
    cells = to_long(df, [era], targets).where(F.col("value").isNotNull())
    mads = median_and_mad(cells, [era, "feature"], "value")
    return mads.groupBy(era).agg(F.max("mad").alias("max_mad")).where(F.col("max_mad") < tol)


def condition_of(c: np.ndarray, shrink: float = 0.0) -> tuple[float, float]:
    """(largest / smallest, smallest) eigenvalue of a correlation matrix."""
    c = np.nan_to_num(c, nan=0.0)
    if shrink > 0:
        c = (1 - shrink) * c + shrink * np.eye(len(c))
    values = np.maximum(np.linalg.eigvalsh(c), EIGENVALUE_FLOOR)
    return float(values[-1] / values[0]), float(values[0])


def condition_number(
    df: DataFrame, features: list[str], groups: list[str], shrink: float = 0.0
) -> DataFrame:
    """(groups, condition, min_eigenvalue) of the features' correlation matrix."""
    p = len(features)

    def solve(batches):
        for batch in batches:
            out = []
            for cov in batch["cov"]:
                cov = np.asarray(cov, dtype=np.float64).reshape(p, p)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.sqrt(np.diag(cov))
                    out.append(condition_of(cov / np.outer(d, d), shrink) if p else (1.0, 1.0))
            made = batch[groups].copy()
            made["condition"] = [o[0] for o in out]
            made["min_eigenvalue"] = [o[1] for o in out]
            yield made

    return second_moments(df, features, groups).select(*groups, "cov").mapInPandas(
        solve, f"{schema_of(df, groups)}, condition double, min_eigenvalue double"
    )


MOMENTS = (
    "n_test long, c_pp array<double>, c_yy array<double>, c_py array<double>, "
    "condition double, min_eigenvalue double"
)


def _clean(
    df: DataFrame, features: list[str], targets: list[str], keys: list[str] | None, era: str
) -> DataFrame:
    names = dict.fromkeys([*features, *targets])
    spare = [c for c in keys or [] if c not in names and c != era]
    return df.select(era, *spare, *[expr.finite(F.col(c)).alias(c) for c in names])


def _stored(
    df: DataFrame, features: list[str], targets: list[str], keys: list[str] | None, era: str, stored: bool
) -> DataFrame:
    """``_clean`` rows, written once: gaps, draws and moments each pass over them. ``stored`` tells that ``df`` is such a table."""
    rows = _clean(df, features, targets, keys, era)
    return rows if stored else written(rows, "clean-rows")


def _median_filled(rows: DataFrame, columns: list[str], era: str) -> DataFrame:
    """Era medians for missing values, 0 in eras without any; columns without gaps are left alone."""
    gaps = rows.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first()
    missing = [c for c in columns if gaps[c]]
    if not missing:
        return rows
    cells = to_long(rows, [era], missing).where(F.col("value").isNotNull())
    middle = exact_median(cells, [era, "feature"], "value", "_m")
    wide = middle.groupBy(era).pivot("feature", missing).agg(F.first("_m"))
    wide = wide.select(F.col(era).alias("_era"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(missing)])
    filled = {c: F.coalesce(c, f"_m{i}", F.lit(0.0)) for i, c in enumerate(missing)}
    return rows.join(wide, F.col(era).eqNullSafe(F.col("_era")), "left").withColumns(filled).select(*rows.columns)


def split_moments(
    rows: DataFrame,
    features: list[str],
    targets: list[str],
    seed: int,
    keys: list[str] | None = None,
    era: str = "era",
) -> DataFrame:
    """(era, n, mean, cov) of all train rows of an era, and the same of its test rows.

    Fits and held-out scores follow from these, so no row is left out and no era
    has to fit in a task.
    """
    split = train_test_split(rows, TRAIN_SHARE, seed, keys, era)
    moments = second_moments(split, [*features, *targets], [era, "is_train"])
    part = F.struct("n", "mean", "cov")
    sides = moments.groupBy(era).agg(
        F.any_value(F.when(F.col("is_train"), part), True).alias("a"),
        F.any_value(F.when(~F.col("is_train"), part), True).alias("b"),
    )
    fields = [F.col(f"{side}.{x}").alias(f"{x}_{side}") for side in "ab" for x in ("n", "mean", "cov")]
    enough = F.col("n_a") + F.col("n_b") >= MIN_ERA_ROWS
    return sides.select(era, *fields).where(enough)


def _blocks(row, p: int) -> list[tuple]:
    """(n, mean, cov xx, cov xy, cov yy) of the train and of the test side."""
    found = []
    for side in "ab":
        mean = np.asarray(row[f"mean_{side}"], dtype=np.float64)
        cov = np.asarray(row[f"cov_{side}"], dtype=np.float64).reshape(len(mean), -1)
        found.append((int(row[f"n_{side}"]), mean, cov[:p, :p], cov[:p, p:], cov[p:, p:]))
    return found


def _solved(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(gram, right)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(gram) @ right


def era_ridge_moments(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    ridge_lambda: float = 1.0,
    feature_fraction: float = 1.0,
    skip_degenerate: bool = False,
    seed: int = 42,
    keys: list[str] | None = None,
    era: str = "era",
    stored: bool = False,
) -> DataFrame:
    """Per era: one ridge fit for all targets, as second moments of its held-out predictions.

    Fitted on 70% of an era's rows, scored on the others, all through second moments. Any
    blend of targets is later scored from the result without touching rows again.
    """
    if 0 < feature_fraction < 1:
        rng = np.random.default_rng(seed)
        k = max(1, int(len(features) * feature_fraction))
        features = [features[i] for i in sorted(rng.choice(len(features), k, replace=False))]
    rows = _stored(df, features, targets, keys, era, stored)
    if skip_degenerate:
        rows = rows.join(bounded(degenerate_eras(rows, targets, era=era)), era, "left_anti")
    rows = _median_filled(rows, list(dict.fromkeys([*features, *targets])), era)
    p, names = len(features), [era, *[c.split()[0] for c in MOMENTS.split(", ")]]

    def fit(batches):
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                (n, _, xx, xy, _), (n_test, _, test_xx, test_xy, test_yy) = _blocks(row, p)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.sqrt(np.diag(xx))
                    condition, smallest = condition_of(xx / np.outer(d, d))
                worse = condition > BAD_CONDITION or smallest < BAD_EIGENVALUE
                lam = ridge_lambda * (10.0 if worse else 1.0)
                beta = _solved(n * xx + lam * np.eye(p), n * xy)
                blocks = (beta.T @ test_xx @ beta, test_yy, beta.T @ test_xy)
                out.append((row[era], n_test, *[b.ravel().tolist() for b in blocks], condition, smallest))
            yield pd.DataFrame(out, columns=names)

    return split_moments(rows, features, targets, seed, keys, era).mapInPandas(
        fit, f"{schema_of(df, [era])}, {MOMENTS}"
    )


def basis_moments(
    df: DataFrame, basis: list[str], targets: list[str], era: str = "era"
) -> DataFrame:
    """The same moments when prediction columns already exist: plain aggregates."""
    def block(left, right):
        return F.array(*[F.covar_pop(a, b) for a in left for b in right])

    cells = [F.col(c).isNotNull() for c in [*basis, *targets]]
    whole = cells[0]
    for c in cells[1:]:
        whole = whole & c
    return df.where(whole).groupBy(era).agg(
        F.count(F.lit(1)).alias("n_test"),
        block(basis, basis).alias("c_pp"),
        block(targets, targets).alias("c_yy"),
        block(basis, targets).alias("c_py"),
    )


def score_by_era(moments: DataFrame, combos: np.ndarray, era: str = "era") -> DataFrame:
    """(era, combo_id, weights, corr): correlation of each blend's prediction and target."""
    spark = moments.sparkSession
    made = spark.createDataFrame(
        [(i, [float(v) for v in w], [float(v) for v in np.outer(w, w).ravel()])
         for i, w in enumerate(combos)],
        "combo_id int, weights array<double>, outer array<double>",
    )
    listed = made.agg(F.collect_list(F.struct("combo_id", "weights", "outer")).alias("c")).scalar()
    rows = moments.where(F.col("n_test") >= 3).select(
        era, "c_pp", "c_yy", "c_py", F.inline(listed)
    )

    def form(block: str) -> Column:
        return F.aggregate(
            F.zip_with(block, "outer", lambda c, w: c * w), F.lit(0.0), lambda s, v: s + v
        )

    spread = F.sqrt(F.greatest(form("c_pp"), F.lit(0.0)) * F.greatest(form("c_yy"), F.lit(0.0)))
    return rows.select(era, "combo_id", "weights", F.try_divide(form("c_py"), spread).alias("corr"))


STATISTICS = ["mean_score", "std_score", "sign_consistency", "sharpe"]


def with_sharpe(df: DataFrame, column: str) -> DataFrame:
    """Replaces an array of valid era correlations by the statistics of a blend.

    Means and medians are repeated alongside the array, not used inside a lambda:
    there they would be worked out again for every element.
    """
    values, n = F.col(column), F.size(column)

    def beside(c):
        return F.array_repeat(F.col(c), n)

    df = df.withColumns({"_mean": expr.array_mean(values), "_middle": expr.array_median(values)})
    squares = F.zip_with(values, beside("_mean"), lambda v, m: (v - m) * (v - m))
    away = F.zip_with(values, beside("_middle"), lambda v, m: F.abs(v - m))
    df = df.withColumns(
        {
            "_std": F.sqrt(
                F.try_divide(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v), n - 1)
            ),
            "_mad": expr.array_median(away),
            "_unique": F.size(F.array_distinct(F.transform(values, lambda v: F.round(v, 12)))),
        }
    )
    mean, std, mad = F.col("_mean"), F.col("_std"), F.col("_mad")
    tol = CONSTANT_TOLERANCE
    width = F.array_max(values) - F.array_min(values)
    flat = (F.col("_unique") <= 1) | (width < tol) | (std < tol) | (mad < tol)
    few = n < 2
    positive = F.size(F.filter(values, lambda v: v > 0))
    return df.withColumns(
        {
            "mean_score": F.when(few, 0.0).otherwise(F.abs(mean)),
            "std_score": F.when(few, 0.0).otherwise(std),
            "sign_consistency": F.when(few, 0.0).otherwise(F.try_divide(positive, n)),
            "sharpe": F.when(few | flat, 0.0)
            .when(std < SHARPE_EPS, F.try_divide(mean, MAD_TO_STD * mad + SHARPE_EPS))
            .otherwise(F.try_divide(mean, std + SHARPE_EPS)),
        }
    ).drop(column, "_mean", "_middle", "_std", "_mad", "_unique")


def score_combinations(scores: DataFrame) -> DataFrame:
    """(combo_id, weights, mean_score, std_score, sign_consistency, sharpe) over all eras."""
    kept = scores.groupBy("combo_id").agg(
        F.first("weights").alias("weights"), F.collect_list("corr").alias("_c")
    )
    return with_sharpe(kept, "_c")


def best_combination(scores: DataFrame, groups: list[str]) -> DataFrame:
    """The blend with the highest Sharpe ratio per group; the earlier one on a tie."""
    w = Window.partitionBy(*groups).orderBy(F.col("sharpe").desc(), "combo_id")
    return scores.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_top(scores: DataFrame, n_combos: int, by: str = "score") -> DataFrame:
    """Blends that pass the pre-screen: the best fifth, at least 15."""
    keep = max(KEEP_AT_LEAST, n_combos // KEEP_SHARE)
    return scores.orderBy(F.col(by).desc(), "combo_id").limit(keep)


def top_features_per_era(
    df: DataFrame, features: list[str], target: str, k: int = TOP_FEATURES, era: str = "era"
) -> DataFrame:
    """The ``k`` features with the largest absolute Pearson correlation per era."""
    cells = to_long(df.select(era, target, *features), [era, target], features)
    corrs = cells.groupBy(era, "feature").agg(
        F.abs(F.coalesce(pearson_of("value", target), F.lit(0.0))).alias("abs_corr")
    )
    pos = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    w = Window.partitionBy(era).orderBy(F.col("abs_corr").desc(), "pos")
    ranked = corrs.withColumn("pos", pos.cast("int")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def prescreen_by_era(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    combos: np.ndarray,
    top_k: int = TOP_FEATURES,
    alpha: float = 1.0,
    seed: int = 42,
    keys: list[str] | None = None,
    era: str = "era",
    stored: bool = False,
) -> DataFrame:
    """(era, combo_id, score): absolute held-out correlation of a small ridge inside each era.

    For each blend the features that correlate best with it are standardised and fitted, from
    the second moments of all rows. An era's scores use no other era.
    """
    rows = _stored(df, features, targets, keys, era, stored).na.fill(0.0, list(dict.fromkeys([*features, *targets])))
    p = len(features)

    def score(batches):
        for batch in batches:
            found = []
            for _, row in batch.iterrows():
                train, test = _blocks(row, p)
                (n, mean, xx, xy, yy), (m, mean_b, test_xx, test_xy, test_yy) = train, test
                gap = np.outer(mean - mean_b, mean - mean_b) * (n * m / (n + m) ** 2)
                whole = [(n * u + m * v) / (n + m) for u, v in zip(train[2:], test[2:])]
                sx = np.sqrt(np.diag(whole[0] + gap[:p, :p]))
                for c, w in enumerate(combos):
                    sy = np.sqrt(max(0.0, w @ (whole[2] + gap[p:, p:]) @ w))
                    if sy < 1e-8:
                        continue
                    r = np.divide(np.abs((whole[1] + gap[:p, p:]) @ w), sx * sy, out=np.zeros(p), where=sx > 0)
                    best = np.argsort(-r, kind="stable")[:top_k]
                    d = np.sqrt(np.diag(xx)[best])
                    d = np.where(d > 0, d, 1.0)
                    gram = n * xx[np.ix_(best, best)] / np.outer(d, d) + alpha * np.eye(len(best))
                    beta = _solved(gram, n * (xy[best] @ w) / d) / d
                    spread = np.sqrt(max(0.0, beta @ test_xx[np.ix_(best, best)] @ beta))
                    held = np.sqrt(max(0.0, w @ test_yy @ w))
                    if spread >= 1e-8 and held >= 1e-8:
                        found.append((row[era], c, float(abs(beta @ test_xy[best] @ w) / (spread * held))))
            yield pd.DataFrame(found, columns=[era, "combo_id", "score"])

    moments = split_moments(rows, features, targets, seed, keys, era)
    return moments.mapInPandas(score, f"{schema_of(df, [era])}, combo_id int, score double")


def ridge_prescreen(
    df: DataFrame, features: list[str], targets: list[str], combos: np.ndarray, era: str = "era", **options
) -> DataFrame:
    """(combo_id, score): the mean of ``prescreen_by_era`` over the eras of ``df``, 0 for less than three eras.

    ``walk_forward`` takes the scores by era and forms this mean over earlier eras only.
    """
    keys = options.get("keys")
    df = _stored(df, features, targets, keys, era, options.pop("stored", False))
    per_era = prescreen_by_era(df, features, targets, combos, era=era, stored=True, **options)
    enough = df.select(F.count_distinct(era).alias("n")).scalar() >= MIN_SCREEN_ERAS
    every = df.sparkSession.range(len(combos)).select(F.col("id").cast("int").alias("combo_id"))
    means = per_era.groupBy("combo_id").agg(F.avg("score").alias("score"))
    return every.join(means, "combo_id", "left").select(
        "combo_id", F.when(enough, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score")
    )


def candidates(
    eras: DataFrame,
    scores: DataFrame,
    n_combos: int,
    history: int = 50,
    warmup: int = 20,
    era: str = "era",
    screen: DataFrame | None = None,
) -> DataFrame:
    """(era, era_idx, combo_id, found, Sharpe columns, rank): every blend that an era may choose from.

    Statistics of an era come from earlier eras only. ``eras`` is (era, era_idx, n_rows), ``scores``
    is (era, combo_id, corr). With ``screen`` (era, combo_id, score) and more than ten blends, only the best
    fifth by mean score over the era's history stays, 15 at least. Each blend's history is a window
    over era-level rows, hence there is no join of eras with eras.
    """
    warm = F.least(F.lit(warmup), F.greatest(F.lit(0), eras.agg(F.max("era_idx")).scalar() - 1))
    ids = F.sequence(F.lit(0), F.lit(n_combos - 1))
    grid = eras.select(era, "era_idx", "n_rows", F.explode(ids).alias("combo_id"))
    past = Window.partitionBy("combo_id").orderBy("era_idx").rangeBetween(-history, -1)
    seen = grid.join(
        scores.select(era, "combo_id", "corr", F.lit(True).alias("scored")), [era, "combo_id"], "left"
    )
    screened = screen is not None and n_combos > SCREEN_ABOVE
    if screened:
        seen = seen.join(screen.select(era, "combo_id", "score"), [era, "combo_id"], "left")
        mean = F.when(F.count(F.lit(1)).over(past) >= MIN_SCREEN_ERAS, F.avg("score").over(past))
        seen = seen.withColumn("_screen", F.coalesce(mean, F.lit(0.0)))
    seen = seen.withColumns(
        {
            "_c": F.collect_list("corr").over(past),
            "_rows": F.sum("n_rows").over(past),
            "_known": F.count(F.when(F.col("scored"), 1)).over(past),
        }
    )
    if screened:
        best = Window.partitionBy(era).orderBy(F.col("_screen").desc(), "combo_id")
        keep = max(KEEP_AT_LEAST, n_combos // KEEP_SHARE)
        seen = seen.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= keep)
    found = (
        (F.col("era_idx") > warm)
        & (F.coalesce("_rows", F.lit(0)) >= MIN_HISTORY_ROWS)
        & (F.col("_known") > 0)
    )
    order = Window.partitionBy(era).orderBy(F.col("sharpe").desc(), "combo_id")
    return (
        with_sharpe(seen.withColumn("found", found), "_c")
        .select(era, "era_idx", "combo_id", "found", *STATISTICS, F.row_number().over(order).alias("rank"))
    )


def chosen(tried: DataFrame, combos: np.ndarray, era: str = "era") -> DataFrame:
    """The candidate with the highest Sharpe ratio of every era, the better ranked one on a tie."""
    order = Window.partitionBy(era, "era_idx").orderBy(F.col("sharpe").desc(), "rank")
    best = tried.withColumn("_best", F.row_number().over(order)).where("_best = 1")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in combos])
    found = F.col("found")
    return best.select(
        era,
        "era_idx",
        F.when(found, F.col("combo_id")).alias("combo_id"),
        F.when(found, table[F.col("combo_id")])
        .otherwise(expr.equal_weights(combos.shape[1]))
        .alias("weights"),
        F.when(found, F.col("sharpe")).alias("sharpe"),
        F.when(found, F.col("mean_score")).alias("mean_score"),
        F.when(found, F.col("sign_consistency")).alias("sign_consistency"),
    )


def walk_forward(
    eras: DataFrame,
    scores: DataFrame,
    combos: np.ndarray,
    history: int = 50,
    warmup: int = 20,
    era: str = "era",
    screen: DataFrame | None = None,
) -> DataFrame:
    """Weights per era from the scores of earlier eras only; see ``candidates``."""
    return chosen(candidates(eras, scores, len(combos), history, warmup, era, screen), combos, era)


def blend_features(
    rows: DataFrame, features: list[str], targets: list[str], combos: np.ndarray, top_k: int, era: str = "era"
) -> dict:
    """{(era, combo): places of the features that correlate best with the blend}, from second moments."""
    p = len(features)

    def pick(batches):
        for batch in batches:
            out = []
            for name, cov in zip(batch[era], batch["cov"]):
                cov = np.asarray(cov, dtype=np.float64).reshape(p + len(targets), -1)
                sx = np.sqrt(np.maximum(0.0, np.diag(cov)[:p]))
                for c, w in enumerate(combos):
                    r = np.divide(np.abs(cov[:p, p:] @ w), sx, out=np.zeros(p), where=sx > 0)
                    out.append((name, c, np.argsort(-r, kind="stable")[:top_k].tolist()))
            yield pd.DataFrame(out, columns=[era, "combo_id", "places"])

    moments = second_moments(rows, [*features, *targets], [era])
    found = moments.select(era, "cov").mapInPandas(pick, f"{schema_of(rows, [era])}, combo_id int, places array<int>")
    return {(r[era], r["combo_id"]): tuple(r["places"]) for r in found.toLocalIterator()}


def best_round(checks: list[np.ndarray], patience: int = PATIENCE) -> np.ndarray:
    """For every model the round whose held-out error is least before ``patience`` rounds bring none lower."""
    error = np.stack([c[:, -1] for c in checks])
    best = np.full(error.shape[1], min(1, len(error) - 1))
    going = np.ones(error.shape[1], dtype=bool)
    models = np.arange(error.shape[1])
    for turn in range(2, len(error)):
        better = going & (error[turn] < error[best, models])
        best = np.where(better, turn, best)
        going &= turn - best < patience
    return best


def boosted_by_era(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    combos: np.ndarray,
    wanted: DataFrame | None = None,
    settings: boosting.Settings = REFINE,
    top_k: int = TOP_FEATURES,
    seed: int = 42,
    keys: list[str] | None = None,
    era: str = "era",
    stored: bool = False,
) -> DataFrame:
    """(era, combo_id, corr): held-out correlation of boosted trees fitted inside an era, per blend.

    All eras and blends in ``wanted`` (era, combo_id), or all there are, grow in the same passes over all
    rows. Each model stops by its own held-out error. An era's scores use no other era, so any history
    is a window over them.
    """
    names = list(dict.fromkeys([*features, *targets]))
    rows = _stored(df, features, targets, keys, era, stored).na.fill(0.0, names)
    sizes = rows.groupBy(era).count().where(F.col("count") >= MIN_ERA_ROWS).select(era)
    spark = df.sparkSession
    if wanted is None:
        ids = F.explode(F.sequence(F.lit(0), F.lit(len(combos) - 1)))
        wanted = sizes.select(era, ids.alias("combo_id"))
    pairs = [(r[era], r["combo_id"]) for r in wanted.select(era, "combo_id").distinct().join(sizes, era).orderBy(
        era, "combo_id").limit(boosting.MAX_MODELS + 1).collect()]
    schema = f"{schema_of(df, [era])}, combo_id int, corr double"
    if not pairs:
        return spark.createDataFrame([], schema)
    places = blend_features(rows, features, targets, combos, top_k, era) if len(features) > top_k else {}
    models = [boosting.ModelKey(e, tuple(map(float, combos[c])), seed, places.get((e, c))) for e, c in pairs]
    split = train_test_split(rows, TRAIN_SHARE, seed, keys, era)
    fitted = boosting.boost(split, features, targets, models, era, settings, "is_train")
    turn = best_round(fitted.checks)
    found = []
    for k, (e, c) in enumerate(pairs):
        n, y, f, yy, ff, yf, _ = fitted.checks[turn[k]][k]
        if n < 2:
            continue
        held, spread = (np.sqrt(max(0.0, q / n - (s / n) ** 2)) for q, s in ((yy, y), (ff, f)))
        if held > FLAT and spread > FLAT:
            found.append((e, c, float((yf / n - y / n * f / n) / (held * spread))))
    return spark.createDataFrame(found, schema)


def _with_refined(tried: DataFrame, refined: DataFrame, eras: DataFrame, history: int, top: int | None, era: str) -> DataFrame:
    """Replaces the statistics of the ``top`` candidates by those of refined scores of earlier eras."""
    leading = F.col("found") & (F.lit(True) if top is None else F.col("rank") <= top)
    by_idx = refined.join(eras.select(era, F.col("era_idx").alias("h")), era).select("h", "combo_id", "corr")
    pasts = tried.where(leading).select(
        era, "era_idx", "combo_id", "found", "rank", F.explode(F.sequence(F.col("era_idx") - history, F.col("era_idx") - 1)).alias("h"))
    lists = pasts.join(by_idx, ["h", "combo_id"], "left").groupBy(era, "era_idx", "combo_id", "found", "rank").agg(
        F.collect_list("corr").alias("_c"))
    return tried.where(~leading).unionByName(with_sharpe(lists, "_c").select(*tried.columns))


def walk_forward_weights(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    history: int = 50,
    warmup: int = 20,
    limit: int | None = None,
    seed: int = 42,
    era: str = "era",
    mode: str = "linear",
    prescreen: bool | None = None,
    refine: boosting.Settings = REFINE,
    keys: list[str] | None = None,
    **ridge,
) -> DataFrame:
    """Rows to weights, each era's from earlier eras only.

    ``linear`` scores all blends by one ridge fit per era. ``hybrid`` pre-screens blends, scores the
    rest the same way and scores the three best of each era again with boosted trees; ``boosted`` does
    so for all that pass the pre-screen. ``prescreen`` turns the pre-screen on or off in any mode. Every
    fit stays inside an era, so it serves all later eras whose history holds it.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    combos = blends(len(targets), limit, seed)
    df = _stored(df, features, targets, keys, era, False)
    moments = era_ridge_moments(df, features, targets, seed=seed, era=era, keys=keys, stored=True, **ridge)
    scores = score_by_era(moments, combos, era)
    eras = era_index(df, era)
    screen = None
    if (mode != "linear" if prescreen is None else prescreen) and len(combos) > SCREEN_ABOVE:
        screen = prescreen_by_era(df, features, targets, combos, seed=seed, keys=keys, era=era, stored=True)
    if mode == "linear":
        return walk_forward(eras, scores, combos, history, warmup, era, screen)
    eras = written(eras, "eras")
    tried = written(candidates(eras, scores, len(combos), history, warmup, era, screen), "candidates")
    top = REFINE_TOP if mode == "hybrid" else None
    leading = tried.where("found") if top is None else tried.where(F.col("found") & (F.col("rank") <= top))
    pasts = leading.select(F.explode(F.sequence(F.col("era_idx") - history, F.col("era_idx") - 1)).alias("era_idx"), "combo_id")
    wanted = pasts.distinct().join(eras.select(era, "era_idx"), "era_idx")
    refined = boosted_by_era(df, features, targets, combos, wanted, refine, seed=seed, keys=keys, era=era, stored=True)
    return chosen(_with_refined(tried, refined, eras, history, top, era), combos, era)


def refine_top_k(
    df: DataFrame,
    features: list[str],
    targets: list[str],
    candidates: DataFrame,
    k: int = REFINE_TOP,
    settings: boosting.Settings = REFINE,
    seed: int = 42,
    keys: list[str] | None = None,
    era: str = "era",
) -> DataFrame:
    """Scores the ``k`` best blends again with boosted trees inside every era of ``df``: (combo_id, Sharpe columns).

    ``df`` is a history: pass only eras before the one that the scores are for, or use
    ``walk_forward_weights`` with mode ``hybrid``, which does so for every era.
    """
    best = candidates.orderBy(F.col("sharpe").desc(), "combo_id").limit(k).collect()
    combos = np.array([r["weights"] for r in best])
    scores = boosted_by_era(df, features, targets, combos, None, settings, seed=seed, keys=keys, era=era)
    names = F.array(*[F.lit(r["combo_id"]) for r in best])
    kept = scores.groupBy(names[F.col("combo_id")].alias("combo_id")).agg(F.collect_list("corr").alias("_c"))
    return with_sharpe(kept, "_c")
