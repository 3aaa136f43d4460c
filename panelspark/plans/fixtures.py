"""Panel-shaped views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import bounded, spread

FEATURES = [
    "feature_quantity", "feature_price", "feature_discount", "feature_tax", "feature_flip",
]
TARGETS = ["target_net", "target_gross", "target_order"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BINNED = ["feature_0", "feature_1", "feature_2", "feature_3"]
LABELS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(number) -> F.Column:
    return F.lpad(number.cast("string"), 4, "0")


def _day() -> F.Column:
    """The ship date's day as a number, which is cheap to group by and to look up."""
    return F.unix_date(F.to_date("l_shipdate"))


def calendar(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """(day, era, era_idx) of the ship dates: one row per day; eras are months or days."""
    days = table(spark, sf_dir, "lineitem").select(_day().alias("day")).distinct()
    idx = F.dense_rank().over(Window.orderBy(F.date_trunc(unit, F.date_from_unix_date("day"))))
    return bounded(days.select("day", padded(idx).alias("era"), idx.alias("era_idx")))


def panel(spark: SparkSession, sf_dir: str, unit: str = "month", days: DataFrame | None = None) -> DataFrame:
    """``days`` is the calendar, if the caller has worked it out."""
    lineitem = table(spark, sf_dir, "lineitem")
    days = calendar(spark, sf_dir, unit) if days is None else days
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("target_order")
    )
    price = F.col("l_extendedprice")
    return (
        spread(lineitem, "l_orderkey").withColumn("day", _day())
        .join(days, "day")
        .join(orders, "l_orderkey")
        .select(
            "era",
            "era_idx",
            *KEYS,
            F.col("l_quantity").alias("feature_quantity"),
            price.alias("feature_price"),
            F.col("l_discount").alias("feature_discount"),
            F.col("l_tax").alias("feature_tax"),
            F.when(F.month("l_shipdate") % 2 == 0, price).otherwise(-price).alias("feature_flip"),
            (price * (1 - F.col("l_discount"))).alias("target_net"),
            (price * (1 + F.col("l_tax"))).alias("target_gross"),
            "target_order",
        )
    )


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir, "day")


def gappy_panel(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """The panel with missing cells: no gross target at zero tax, no quantity at zero discount."""
    return panel(spark, sf_dir, days=days).withColumns(
        {
            "target_gross": F.when(F.col("feature_tax") > 0, F.col("target_gross")),
            "feature_quantity": F.when(F.col("feature_discount") > 0, F.col("feature_quantity")),
        }
    )


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order price as a series with mean 20 and deviation 7."""
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("month", "o_orderdate").alias("mon"))
        .agg(F.avg("o_totalprice").alias("a"))
    )
    whole = Window.partitionBy()
    return bounded(
        monthly.select(
            padded(F.row_number().over(Window.orderBy("mon"))).alias("era"),
            (20 + 7 * (F.col("a") - F.avg("a").over(whole)) / F.stddev_samp("a").over(whole)).alias(
                "vix"
            ),
        )
    )


def era_weights(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """Tidy (era, target_idx, w); every tenth era has none."""
    days = calendar(spark, sf_dir) if days is None else days
    eras = days.where("era_idx % 10 <> 0").select("era", "era_idx").distinct()
    return eras.select(
        "era", "era_idx", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("target_idx")
    ).select(
        "era",
        "target_idx",
        ((1 + (F.col("era_idx") + F.col("target_idx")) % 3) / F.lit(6.0)).alias("w"),
    )


def panel_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.select(
        "era",
        "era_idx",
        F.floor(F.col("feature_quantity") / 10).cast("double").alias("feature_0"),
        F.round(F.col("feature_discount") * 100).alias("feature_1"),
        F.round(F.col("feature_tax") * 100).alias("feature_2"),
        F.col("l_linenumber").cast("double").alias("feature_3"),
        (F.col("target_net") / 100000.0).alias("target"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices per ticker; the order priority is the ticker."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.groupBy(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(
        F.min(price).alias("Low"),
        F.max(price).alias("High"),
        F.avg(price).alias("Open"),
        F.avg(price).alias("Close"),
        F.count(F.lit(1)).alias("Volume"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select(
        "era",
        "era_idx",
        F.col("target_net").alias("target"),
        (F.col("feature_price") + 100 * F.col("feature_quantity")).alias("prediction"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, era, features array, target_0..9)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        padded(F.floor(F.col("vec_id") / 100)).alias("era"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
        *[(F.col("label") == k).cast("double").alias(f"target_{k}") for k in range(LABELS)],
    )


def vector_panel(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select(
        "vec_id",
        "era",
        *[F.col("features")[i].alias(f"feature_{i}") for i in range(width)],
        *[f"target_{k}" for k in range(LABELS)],
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("prediction"),
        F.col("user_id").alias("target"),
    )


def labelled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with indicator and regime; eras without indicator are unknown."""
    from panelspark.functions.expr import regime_by_level
    from panelspark.operators.regimes import join_indicator

    p = join_indicator(panel(spark, sf_dir), indicator(spark, sf_dir))
    return p.withColumn("regime", regime_by_level(F.col("vix")))
