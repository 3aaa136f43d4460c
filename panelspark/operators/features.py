"""Engineered feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.functions.correlation import spearman_features, to_long
from panelspark.functions.ranking import exact_median
from panelspark.operators import pairs
from panelspark.operators.stability import RATIO_EPS, pairs_of, ratio_of
from panelspark.session import all_rows, bounded, written

# Name patterns, guards and caps of the engineered columns.
PATH_NAME = "path_{i:02d}_{a}x{b}"
PATH_RATIO_NAME = "path_{i:02d}_ratio_{a}_{b}"
PATH_DIFF_NAME = "path_{i:02d}_diff_{a}_{b}"
MATH_RATIO_NAME = "ratio_{a}_{b}_{i:02d}"
MATH_DIFF_NAME = "diff_{a}_{b}_{i:02d}"
NAME_SUFFIX = 4
PATH_RATIO_EPS = 1e-6
MAX_PATH_RATIOS, MAX_PATH_DIFFS = 30, 15
MATH_VALID_SHARE = 0.8
STD_FLOOR = 1e-12


def _edges(relationships) -> list:
    """Edge rows in order; accepts a small table or a list of rows."""
    if isinstance(relationships, DataFrame):
        relationships = all_rows(relationships)
    return [r.asDict() if hasattr(r, "asDict") else dict(r) for r in relationships]


def interaction_features(df: DataFrame, relationships, limit: int | None = None) -> DataFrame:
    """Products of related pairs. A skipped pair still uses up its number."""
    made = {}
    for i, edge in enumerate(_edges(relationships)[:limit]):
        a, b = edge["feature1"], edge["feature2"]
        if a in df.columns and b in df.columns:
            name = PATH_NAME.format(i=i, a=a[-NAME_SUFFIX:], b=b[-NAME_SUFFIX:])
            strength = float(edge.get("strength", 1.0))
            made[name] = (F.col(a) * F.col(b) * strength).cast("float")
    return df.withColumns(made) if made else df


def yolo_features(df: DataFrame, relationships) -> DataFrame:
    """Ratios of the first 30 and differences of the first 15 related pairs."""
    made = {}
    for i, edge in enumerate(_edges(relationships)):
        a, b = edge["feature1"], edge["feature2"]
        if a not in df.columns or b not in df.columns:
            continue
        strength = float(edge.get("strength", 1.0))
        tail = {"i": i, "a": a[-NAME_SUFFIX:], "b": b[-NAME_SUFFIX:]}
        if i < MAX_PATH_RATIOS:
            ratio = ratio_of(a, b, PATH_RATIO_EPS) * strength
            made[PATH_RATIO_NAME.format(**tail)] = ratio.cast("float")
        if i < MAX_PATH_DIFFS:
            made[PATH_DIFF_NAME.format(**tail)] = ((F.col(a) - F.col(b)) * strength).cast("float")
    return df.withColumns(made) if made else df


def math_features(df: DataFrame, base: list[str], max_pairs: int | None = None) -> DataFrame:
    """Ratio (when over 80% valid) and difference of each ordered pair of base features."""
    used = pairs_of(base, max_pairs)
    if not used:
        return df
    # a ratio of finite columns is missing only where one side is
    poor = {r["pair"] for r in _shares(df, base).where(
        F.coalesce("valid_share", F.lit(0.0)) <= MATH_VALID_SHARE).select("pair").toLocalIterator()}
    made = {}
    for i, (a, b) in enumerate(used):
        tail = {"i": i, "a": a.split("_")[-1], "b": b.split("_")[-1]}
        if i not in poor:
            made[MATH_RATIO_NAME.format(**tail)] = ratio_of(a, b)
        made[MATH_DIFF_NAME.format(**tail)] = F.col(a) - F.col(b)
    return df.withColumns(made)


def neutralize(
    df: DataFrame, features: list[str], target: str, strength: float = 0.5
) -> DataFrame:
    """Subtracts part of the target from each feature (training data only: it needs labels).

    Features without a correlation are left out.
    """
    whole = df.select(F.lit("all").alias("_all"), *features, target)
    rho = {
        r["feature"]: r["corr"]
        for r in spearman_features(whole, ["_all"], features, target).collect()
    }
    return df.withColumns(
        {
            f"{f}_neutralized": F.col(f) - strength * rho[f] * F.col(target)
            for f in features
            if rho.get(f) is not None
        }
    )


def _shares(df: DataFrame, features: list[str]) -> DataFrame:
    """(pair, i, j, valid_share) of all pairs, from the patterns of missing values."""
    p = len(features)
    patterns = pairs.null_patterns(df, features)
    n = patterns.agg(F.sum("n")).first()[0]
    share = F.coalesce("n_valid", F.lit(0)) / F.lit(float(n)) if n else F.lit(None).cast("double")
    return pairs.pair_table(df.sparkSession, p).join(
        pairs.pair_counts(patterns, p).select("pair", "n_valid"), "pair", "left").select(
        "pair", "i", "j", share.alias("valid_share"))


def feature_pairs(df: DataFrame, features: list[str], limit: int | None = None) -> DataFrame:
    """(pair_idx, feature1, feature2, valid_share): pairs i < j with their complete rows."""
    names = F.array(*[F.lit(f) for f in features])
    found = _shares(df, features) if limit is None else _shares(df, features).where(F.col("pair") < limit)
    return found.select(F.col("pair").cast("int").alias("pair_idx"), names[F.col("i")].alias("feature1"),
                        names[F.col("j")].alias("feature2"), "valid_share")


def math_pairs(df: DataFrame, keys: list[str], base: list[str]) -> DataFrame:
    """(keys, pair, ratio, diff): the mathematical features as rows, for any number of features.

    ``pair`` counts pairs i < j in order. A ratio is NULL where its pair has too few complete rows.
    """
    x = pairs.doubles(base)
    diffs = F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: a - b)))
    both = F.arrays_zip(pairs.ratio_cells(x, RATIO_EPS).alias("ratio"), diffs.alias("diff"))
    cells = df.select(*keys, F.posexplode(both).alias("_at", "_v")).select(
        *keys, F.col("_at").cast("long").alias("pair"), "_v.ratio", "_v.diff")
    poor = _shares(df, base).where(F.coalesce("valid_share", F.lit(0.0)) <= MATH_VALID_SHARE)
    poor = poor.select("pair", F.lit(True).alias("_poor"))
    return cells.join(poor, "pair", "left").select(
        *keys, "pair", F.when(F.col("_poor").isNull(), F.col("ratio")).alias("ratio"), "diff")


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(expr.finite(F.col(c)), F.lit(0.0)) for c in columns})


def impute_median(df: DataFrame, columns: list[str], era: str = "era") -> DataFrame:
    """NULLs become the era's exact median; 0 where an era has no value at all."""
    cells = to_long(df, [era], columns)
    medians = (
        exact_median(cells, [era, "feature"], "value")
        .groupBy(era)
        .pivot("feature", columns)
        .agg(F.first("median"))
        .select(era, *[F.col(c).alias(f"_m_{c}") for c in columns])
    )
    filled = df.join(bounded(medians), era, "left").withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}
    )
    return filled.drop(*[f"_m_{c}" for c in columns])


def column_stats(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation (at least tiny, else 1) of each column over the training rows."""
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    stats = {}
    for i, c in enumerate(columns):
        std = row[f"s{i}"]
        stats[c] = (row[f"m{i}"], 1.0 if std is None or std < STD_FLOOR else std)
    return stats


def zpos_binarize(df: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """Boolean columns: is the z-score, by training statistics, above zero."""
    stats = column_stats(train if train is not None else df, columns)
    return df.withColumns(
        {c: ((F.col(c) - stats[c][0]) / stats[c][1]) > 0.0 for c in columns}
    )


def zpos_array(df: DataFrame, vector: str, out: str = "bits") -> DataFrame:
    """The same for one array column: position means come from one aggregation."""
    means = (
        df.select(F.posexplode(vector).alias("i", "x"))
        .groupBy("i")
        .agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean", "std"))).alias("stats"))
    )
    floor = F.lit(STD_FLOOR)
    return (
        df.withColumn("_stats", means.select("stats").scalar())
        .withColumn(
            out,
            F.zip_with(
                vector,
                "_stats",
                lambda x, s: (x - s["mean"]) / F.when(s["std"] < floor, 1.0).otherwise(s["std"]) > 0,
            ),
        )
        .drop("_stats")
    )


def k_center_prototypes(
    df: DataFrame, vector: str, key: str, k: int, start: int | None = None, seed: int = 0
) -> DataFrame:
    """Farthest-first selection: (pos, key, distance when chosen).

    Each of the ``k`` passes works out one distance a row and writes the smallest so far, with
    the vectors, for the next; only the chosen vectors reach the driver.
    """
    rows = df.select(key, vector)
    if start is not None:
        first = rows.where(F.col(key) == start).first()
    else:
        first = rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).first()
    if first is None:
        raise ValueError("no starting row")
    chosen = [(0, first[0], 0.0)]
    centre = [float(x) for x in first[1]]
    near = rows.withColumn("_d", F.lit(float("inf")))
    while len(chosen) < k:
        squares = F.zip_with(
            vector, F.array(*[F.lit(x) for x in centre]), lambda a, b: (a - b) * (a - b)
        )
        gap = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d))
        near = written(near.withColumn("_d", F.least("_d", gap)), "nearest")
        far = near.agg(
            F.max_by(F.struct(key, vector, "_d"), F.struct("_d", -F.col(key))).alias("r")
        ).first()["r"]
        if far is None or far["_d"] <= 0.0:
            break
        chosen.append((len(chosen), far[key], float(far["_d"])))
        centre = [float(x) for x in far[vector]]
    return df.sparkSession.createDataFrame(chosen, f"pos int, {key} long, distance double")


def tversky_scores(
    df: DataFrame, bits: str, prototypes: list[list[bool]], alpha=0.7, beta=0.3, theta=1.0
) -> DataFrame:
    """One similarity column per prototype (the k prototypes are a plan constant)."""
    return df.withColumns(
        {
            f"tversky_{i}": expr.tversky(
                F.col(bits), F.array(*[F.lit(bool(b)) for b in p]), alpha, beta, theta
            )
            for i, p in enumerate(prototypes)
        }
    )
