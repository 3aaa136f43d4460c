"""Feature pairs as rows: validity and ratios of all pairs, with plans that do not grow with the pairs.

A pair i < j of a feature list has the number ``pair`` in that order. Cells of a pair are rows or
arrays keyed by that number, never columns of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.correlation import joined_rank, spearman
from panelspark.session import written

#: Distinct values of a pair that a task ranks, unless there are more than MAX_CUTS times as many rows.
BUCKET_ROWS = 1 << 20
MAX_CUTS = 2_000
SAMPLE_PER_CUT = 20
#: Numbers that a task holds before it hands on sorted runs, and bytes in a batch of runs.
HELD = 1 << 22
BATCH = 8 << 20


def pair_count(p: int) -> int:
    return p * (p - 1) // 2


def pair_of(i: Column, j: Column, p: int) -> Column:
    return (F.shiftright(i * (2 * p - 1 - i), 1) + j - i - 1).cast("long")


def pair_table(spark: SparkSession, p: int) -> DataFrame:
    """(pair, i, j) of all pairs of ``p`` features."""
    firsts = spark.range(max(0, p - 1)).select(F.col("id").alias("i"))
    both = firsts.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(p - 1).cast("long"))).alias("j"))
    return both.select(pair_of(F.col("i"), F.col("j"), p).alias("pair"), F.col("i").cast("int").alias("i"),
                       F.col("j").cast("int").alias("j"))


def doubles(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def null_patterns(df: DataFrame, features: list[str]) -> DataFrame:
    """(present, n): which features have a value, as positions, and in how many rows."""
    places = F.sequence(F.lit(0), F.lit(len(features) - 1))
    present = F.filter(places, lambda k: F.col("_x")[k].isNotNull())
    found = df.select(F.array(*[F.col(f) for f in features]).alias("_x")).select(present.alias("present"))
    return written(found.groupBy("present").agg(F.count("*").alias("n")), "null-patterns")


def pair_counts(patterns: DataFrame, p: int) -> DataFrame:
    """(pair, i, j, n_valid) of the pairs that have a complete row; rows count by pattern only."""
    i = patterns.select("present", "n", F.explode("present").alias("i"))
    both = i.select("n", "i", F.explode(F.filter("present", lambda k: k > F.col("i"))).alias("j"))
    return both.groupBy("i", "j").agg(F.sum("n").alias("n_valid")).select(
        pair_of(F.col("i"), F.col("j"), p).alias("pair"), "i", "j", "n_valid")


def ratio_cells(x: Column, eps: float) -> Column:
    """Ratios of all pairs of an array's elements, in the order of pairs."""
    return F.flatten(F.transform(x, lambda a, i: F.transform(
        F.slice(x, i + 2, F.size(x)), lambda b: a / (F.abs(b) + eps))))


def _cut_sample(rows: DataFrame, n: int, cuts: int) -> np.ndarray | None:
    """A bounded sample of rows to cut values at; it decides balance only, never a result."""
    if not cuts:
        return None
    share = min(1.0, 2 * SAMPLE_PER_CUT * cuts / n)
    drawn = F.conv(F.substring(F.md5(F.to_json(F.struct("_x", "_y")).cast("binary")), 1, 8), 16, 10).cast("long")
    table = rows.where(drawn < int(share * (1 << 32))).select("_x").limit(4 * SAMPLE_PER_CUT * cuts).toArrow()
    return np.array(table.column("_x").to_pylist(), dtype=np.float64).reshape(table.num_rows, -1)


RUN = "pair long, bucket int, v binary, w binary, s binary"
PART = "pair long, bucket int, n double, s_y double, s_ly double, s_ll double"


def _sorted_runs(p: int, eps: float, sample: np.ndarray | None, cuts: int):
    """Row batches to runs: for every pair the distinct ratios in order, how often, and their sums of ``_ry``."""
    names = [f.split()[0] for f in RUN.split(", ")]

    def splitters(i: int):
        if sample is None or not len(sample):
            return None
        ratios = sample[:, i: i + 1] / (np.abs(sample[:, i + 1:]) + eps)
        return np.quantile(ratios, np.arange(1, cuts + 1) / (cuts + 1), axis=0, method="lower")

    def emit(x: np.ndarray, ry: np.ndarray):
        made, size, pair = [], 0, 0
        for i in range(p - 1):
            ratios = x[:, i: i + 1] / (np.abs(x[:, i + 1:]) + eps)
            order, at = np.argsort(ratios, axis=0), splitters(i)
            for k in range(ratios.shape[1]):
                v = ratios[order[:, k], k]
                starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                w = np.diff(np.concatenate([starts, [len(v)]])).astype(np.int32)
                s, v = np.add.reduceat(ry[order[:, k]], starts), v[starts]
                ends = [len(v)] if at is None else [*np.searchsorted(v, at[:, k], "right"), len(v)]
                lo = 0
                for bucket, hi in enumerate(ends):
                    if hi > lo:
                        made.append((pair, bucket, v[lo:hi].tobytes(), w[lo:hi].tobytes(), s[lo:hi].tobytes()))
                        size += 20 * (hi - lo) + 40
                        lo = hi
                pair += 1
                if size > BATCH:
                    yield batch_of(made)
                    made, size = [], 0
        if made:
            yield batch_of(made)

    def batch_of(made):
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            held.append((flat, batch.column("_ry").to_numpy(zero_copy_only=False)))
            size += flat.size
            if size > HELD:
                yield from emit(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield from emit(*map(np.concatenate, zip(*held)))

    return run


def _merged(key, runs):
    """Sums over one bucket of one pair, with ranks counted from the bucket's middle."""
    def joined(name, kind):
        return np.concatenate([np.frombuffer(b, kind) for b in runs.column(name).to_pylist()])

    v, w, s = joined("v", np.float64), joined("w", np.int32), joined("s", np.float64)
    order = np.argsort(v, kind="stable")
    v, w, s = v[order], w[order].astype(np.float64), s[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    w, s = np.add.reduceat(w, starts), np.add.reduceat(s, starts)
    rank = np.cumsum(w) - (w - 1) / 2
    n = w.sum()
    rank -= (n + 1) / 2
    return pa.table({"pair": [key[0].as_py()], "bucket": pa.array([key[1].as_py()], pa.int32()), "n": [n],
                     "s_y": [s.sum()], "s_ly": [rank @ s], "s_ll": [w @ (rank * rank)]})


def whole_ratio_correlations(
    df: DataFrame, features: list[str], target: str, eps: float, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(pair, corr): rank correlation with the target of the ratio of every pair of features.

    No feature may have a missing value; if the target has one, all correlations are NULL. The target is
    ranked once. Tasks turn their rows into one sorted run for each pair, in which equal ratios are one
    entry; only runs are shuffled, dealt by pair and range of values, so neither a pair nor a mass
    of equal ratios has to fit in a task. Ranks inside a bucket count from its middle, so a
    bucket's place among the others enters a pair's sums as one number.
    """
    p = len(features)
    spark = df.sparkSession
    rows = df.select(F.lit("all").alias("_all"), F.col(target).alias("_y"), doubles(features).alias("_x"))
    ranked = written(joined_rank(rows, ["_all"], "_y")[0].select("_x", "_y", "_ry"), "ranked-rows")
    whole = ranked.agg(F.count("*"), F.count("_ry"), F.sum(F.col("_ry") * F.col("_ry"))).first()
    n, s_yy = whole[0], whole[2]
    if p < 2 or not n or whole[1] < n:
        return pair_table(spark, p if n else 0).select("pair", F.lit(None).cast("double").alias("corr"))
    cuts = min(MAX_CUTS, -(-n // bucket_rows) - 1)
    runs = ranked.select("_x", "_ry").mapInArrow(_sorted_runs(p, eps, _cut_sample(ranked, n, cuts), cuts), RUN)
    parts = written(runs.groupBy("pair", "bucket").applyInArrow(_merged, PART), "pair-ranks")
    before = Window.partitionBy("pair").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("n").over(before), F.lit(0.0)) + (F.col("n") + 1) / 2 - (n + 1) / 2
    placed = parts.withColumn("_c", middle)
    top = F.sum(F.col("_c") * F.col("s_y") + F.col("s_ly"))
    spread = F.sum(F.col("n") * F.col("_c") * F.col("_c") + F.col("s_ll"))
    return placed.groupBy("pair").agg(F.try_divide(top, F.sqrt(spread * F.lit(float(s_yy)))).alias("corr"))


def ratio_correlations(
    df: DataFrame, features: list[str], target: str, eps: float, valid_share: float = 0.0
) -> DataFrame:
    """(pair, i, j, corr) of the pairs with at least ``valid_share`` complete rows.

    Pairs of features without gaps share the target's ranks. For the others the target is ranked
    among each pair's complete rows, from cells keyed by the pair.
    """
    p = len(features)
    spark = df.sparkSession
    empty = pair_table(spark, 0).withColumn("corr", F.lit(None).cast("double"))
    if p < 2:
        return empty
    patterns = null_patterns(df, features)
    known = patterns.agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.size("present"))).alias("sizes")).first()
    if not known["n"]:
        return empty
    n = known["n"]
    full = list(range(p))
    if known["sizes"] != [p]:
        counts = patterns.select("n", F.explode("present").alias("i")).groupBy("i").agg(F.sum("n").alias("n"))
        full = sorted(r["i"] for r in counts.where(F.col("n") == n).collect())  # at most one row for each feature
    found = whole_ratio_correlations(df, [features[i] for i in full], target, eps)
    places = F.array(*[F.lit(i) for i in full])
    local = pair_table(spark, len(full)).select("pair", places[F.col("i")].alias("i"), places[F.col("j")].alias("j"))
    out = found.join(local, "pair").select(pair_of(F.col("i"), F.col("j"), p).alias("pair"), "i", "j", "corr")
    if len(full) == p:
        return out
    gappy = pair_counts(patterns, p).where(
        (F.col("n_valid") < n) & (F.col("n_valid") / n >= valid_share)).select("pair", "i", "j")
    cells = df.select(F.col(target).alias("_y"), F.posexplode(ratio_cells(doubles(features), eps)).alias("_at", "_v"))
    kept = cells.where("_v is not null").join(gappy.select(F.col("pair").alias("_at")), "_at")
    corrs = spearman(kept, ["_at"], "_v", "_y").select(F.col("_at").alias("pair"), "corr")
    return out.unionByName(gappy.join(corrs, "pair").select("pair", "i", "j", "corr"))
