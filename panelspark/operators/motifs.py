"""Motifs: runs of adjacent feature values and the target they go with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expr import finite
from panelspark.session import all_rows

# Closeness used when a motif is matched, and the column name pattern.
REL_TOL, ABS_TOL = 1e-5, 1e-8
MOTIF_NAME = "motif_{i:02d}_{parts}"
NAME_SUFFIX = 4


def motif_mine(
    df: DataFrame,
    features: list[str],
    target: str,
    lengths: list[int],
    eras: list[str] | None = None,
    era: str = "era",
) -> DataFrame:
    """(start, motif_values, count, avg_target, score) of every window of every length.

    Rows collapse to their distinct value vectors first, so coarse features are cut
    into windows once per vector and not once per row.
    """
    if not lengths:
        raise ValueError("lengths must not be empty")
    if eras is not None:
        df = df.where(F.col(era).isin(eras))
    values = F.array(*[F.col(f).cast("double") for f in features])
    vectors = (
        df.select(values.alias("v"), finite(F.col(target)).alias("y"))
        .where(F.col("y").isNotNull())
        .groupBy("v")
        .agg(F.sum("y").alias("sum_target"), F.count(F.lit(1)).alias("count"))
    )
    spans = [
        F.struct(F.lit(i).alias("start"), F.slice("v", i + 1, n).alias("motif_values"))
        for n in sorted(set(lengths))
        for i in range(len(features) - n + 1)
    ]
    windows = vectors.select("sum_target", "count", F.inline(F.array(*spans)))
    return (
        windows.groupBy("start", "motif_values")
        .agg(F.sum("sum_target").alias("sum_target"), F.sum("count").alias("count"))
        .withColumn("avg_target", F.col("sum_target") / F.col("count"))
        .withColumn("score", F.col("avg_target") * F.log1p(F.col("count")))
        .drop("sum_target")
    )


def top_motifs(
    motifs: DataFrame, features: list[str], min_count: int = 10, k: int = 100
) -> DataFrame:
    """The best motifs with their feature names."""
    names = F.array(*[F.lit(f) for f in features])
    return (
        motifs.where(F.col("count") >= min_count)
        .orderBy(F.col("score").desc(), "start", F.size("motif_values"), "motif_values")
        .limit(k)
        .select(
            "start",
            F.slice(names, F.col("start") + 1, F.size("motif_values")).alias("motif_features"),
            "motif_values",
            "score",
            "avg_target",
            "count",
        )
    )


def motif_flags(df: DataFrame, motifs, limit: int | None = None) -> DataFrame:
    """One 0/1 column per motif whose features all exist."""
    rows = all_rows(motifs) if isinstance(motifs, DataFrame) else list(motifs)
    made = {}
    for i, m in enumerate(rows[:limit]):
        names, values = list(m["motif_features"]), list(m["motif_values"])
        if not all(n in df.columns for n in names):
            continue
        match = F.lit(True)
        for n, v in zip(names, values):
            near = F.abs(F.col(n) - F.lit(v)) <= ABS_TOL + REL_TOL * abs(v)
            match = match & F.coalesce(near, F.lit(False))
        parts = "_".join(n[-NAME_SUFFIX:] for n in names)
        made[MOTIF_NAME.format(i=i, parts=parts)] = match.cast("tinyint")
    return df.withColumns(made) if made else df
