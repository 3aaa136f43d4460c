"""Data quality checks of a panel in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.correlation import pearson_of
from panelspark.sources.panel import era_index

# Limits of the checks.
MIN_ROWS_PER_ERA = 10
TARGET_RANGE = (-10.0, 10.0)
TARGET_STD = (0.01, 1.0)
CORRELATION_RANGE = (0.01, 0.99)


def panel_quality(
    df: DataFrame, features: list[str], targets: list[str], target: str, era: str = "era"
) -> DataFrame:
    """(check, value, passed) rows: era sequence, rows per era, targets, correlations.

    ``target`` is the column the features are correlated with.
    """
    number = F.col(era).try_cast("int")
    eras = era_index(df, era).agg(
        F.count_if(~number.eqNullSafe(F.col("era_idx"))).cast("double").alias("gaps"),
        F.min("n_rows").cast("double").alias("rows"),
    )
    corrs = [F.abs(pearson_of(f, target)) for f in features]
    columns = df.agg(
        F.array_max(F.array(*corrs)).alias("corr"),
        *[
            agg.cast("double").alias(f"{name}_{t}")
            for t in targets
            for name, agg in (
                ("min", F.min(t)),
                ("max", F.max(t)),
                ("std", F.stddev_samp(t)),
                ("nulls", F.count_if(F.col(t).isNull())),
            )
        ],
    )

    def check(name, value, test):
        v = F.col(value)
        return F.struct(
            F.lit(name).alias("check"), v.alias("value"), F.coalesce(test(v), F.lit(False)).alias("passed")
        )

    low, high = CORRELATION_RANGE
    of_eras = [
        check("eras_sequential", "gaps", lambda v: v == 0),
        check("min_rows_per_era", "rows", lambda v: v > MIN_ROWS_PER_ERA),
    ]
    of_columns = [check("max_abs_correlation", "corr", lambda v: (v > low) & (v < high))]
    for t in targets:
        of_columns += [
            check(f"min_{t}", f"min_{t}", lambda v: v > TARGET_RANGE[0]),
            check(f"max_{t}", f"max_{t}", lambda v: v < TARGET_RANGE[1]),
            check(f"std_{t}", f"std_{t}", lambda v: (v > TARGET_STD[0]) & (v < TARGET_STD[1])),
            check(f"nulls_{t}", f"nulls_{t}", lambda v: v == 0),
        ]
    return eras.select(F.inline(F.array(*of_eras))).unionByName(
        columns.select(F.inline(F.array(*of_columns)))
    )
