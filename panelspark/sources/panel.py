"""Panel scans, schema operators, row and era limits, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.expr import finite
from panelspark.functions.ranking import top_rows
from panelspark.session import bounded

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating-point column."""
    fixed = {
        f.name: finite(F.col(f.name)).cast(f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, FRACTIONAL)
    }
    return df.select(*[fixed.get(c, F.col(c)).alias(c) for c in df.columns])


def scan_panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return clean(df.select(*columns) if columns else df)


def scan_eras(
    spark: SparkSession,
    path: str,
    eras: list,
    columns: list[str] | None = None,
    era: str = "era",
) -> DataFrame:
    """A scan limited to listed eras; the filter reaches the file scan or its partitions."""
    df = spark.read.parquet(path).where(F.col(era).isin(list(eras)))
    return clean(df.select(*columns) if columns else df)


def prefixed(
    columns: list[str], prefix: str, limit: int | None = None, tail: bool = False
) -> list[str]:
    names = [c for c in columns if c.startswith(prefix)]
    if limit is None:
        return names
    return names[-limit:] if tail else names[:limit]


def select_by_prefix(
    df: DataFrame,
    prefix: str,
    limit: int | None = None,
    tail: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    return df.select(*keep, *prefixed(df.columns, prefix, limit, tail))


def align_features(
    train: DataFrame, valid: DataFrame, desired: list[str] | None, target: str
) -> list[str]:
    """Features both tables have, in the wanted order, never the target."""
    wanted = desired if desired is not None else prefixed(train.columns, "feature")
    both = set(train.columns) & set(valid.columns) - {target}
    return [c for c in dict.fromkeys(wanted) if c in both]


def row_order(df: DataFrame, era: str = "era") -> list[Column]:
    """The default order of rows: era, then a hash of the whole row."""
    return [F.col(era), F.xxhash64(*df.columns)]


def limit_rows(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    return df.orderBy(*(order or row_order(df))).limit(n)


def limit_rows_per_era(
    df: DataFrame, n: int, order: list[Column] | None = None, era: str = "era"
) -> DataFrame:
    return top_rows(df, [era], order or row_order(df, era), n)


def era_index(df: DataFrame, era: str = "era") -> DataFrame:
    """(era, era_idx, n_rows): one row per era, so the global window is small."""
    eras = df.where(F.col(era).isNotNull()).groupBy(era).agg(F.count(F.lit(1)).alias("n_rows"))
    return bounded(eras.withColumn("era_idx", F.row_number().over(Window.orderBy(era))))


def restrict_eras(
    df: DataFrame,
    first: int | None = None,
    last: int | None = None,
    within_rows: int | None = None,
    era: str = "era",
) -> DataFrame:
    """Rows of the first or last eras, or of the eras met within the first rows in era order."""
    eras = era_index(df, era)
    if first is not None:
        eras = eras.where(F.col("era_idx") <= first)
    if last is not None:
        n = eras.count()
        eras = eras.where(F.col("era_idx") > n - last)
    if within_rows is not None:
        earlier = Window.orderBy("era_idx").rowsBetween(Window.unboundedPreceding, -1)
        eras = eras.withColumn(
            "_before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))
        ).where(F.col("_before") < within_rows)
    return df.join(bounded(eras.select(era)), era, "left_semi")


def narrow_types(df: DataFrame) -> DataFrame:
    """Casts numeric columns to the smallest type whose open range holds the column.

    One pass finds all ranges. Half floats do not exist here, so doubles narrow to
    float. A column without values keeps its type.
    """
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, INTEGRAL + FRACTIONAL)]
    if not numeric:
        return df
    ranges = df.agg(
        *[
            agg(f.name).cast("double").alias(f"{name}_{i}")
            for i, f in enumerate(numeric)
            for name, agg in (("min", F.min), ("max", F.max))
        ]
    ).first()
    casts = {}
    for i, f in enumerate(numeric):
        low, high = ranges[f"min_{i}"], ranges[f"max_{i}"]
        if low is None:
            continue
        if isinstance(f.dataType, INTEGRAL):
            choices = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
            fit = [t for t, top in choices if low > -top and high < top - 1]
        else:
            fit = ["float"] if low > -3.4028234e38 and high < 3.4028234e38 else []
        if fit:
            casts[f.name] = F.col(f.name).cast(fit[0])
    return df.select(*[casts.get(c, F.col(c)).alias(c) for c in df.columns])


def write_panel(df: DataFrame, path: str, partition_by: str | None = "era", mode: str = "overwrite"):
    """Parquet, one folder per era; eras are gathered into few files, hot ones are split."""
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def sequential_ids(df: DataFrame, order: list[Column], out: str = "id") -> DataFrame:
    """0-based positions in a global order, without sorting in one task.

    The sorted rows are checkpointed, so the per-partition positions and the
    partition sizes come from the same files.
    """
    from panelspark.session import shared_dir

    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "ids"))
    mark = F.monotonically_increasing_id()
    ordered = df.orderBy(*order).select(
        "*",
        F.shiftright(mark, 33).cast("int").alias("_part"),
        mark.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    ).checkpoint()
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return ordered.join(bounded(starts), "_part").select(
        (F.col("_start") + F.col("_at")).alias(out), *df.columns
    )


def write_predictions(
    df: DataFrame, path: str, id_col: str | None = None, order: list[Column] | None = None
) -> DataFrame:
    """CSV with ``id,prediction``; without an id column, rows are numbered in ``order``."""
    if id_col is None:
        df, id_col = sequential_ids(df, order or row_order(df)), "id"
    out = df.select(F.col(id_col).alias("id"), F.col("prediction"))
    out.write.mode("overwrite").option("header", True).csv(path)
    return out
