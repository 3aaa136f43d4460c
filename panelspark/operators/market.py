"""Aligning daily price histories to eras."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import bounded

# Column suffix of each per-ticker feature.
SUFFIX = {"close": "close", "ret": "ret", "zscore": "zret", "ensemble_ret": "ret"}
ERA_WIDTH = 4


def ordinal_era_map(prices: DataFrame, date: str = "date") -> DataFrame:
    """(era, date): distinct dates in order, numbered 0001 upward (one row per day)."""
    days = prices.select(F.col(date).cast("date").alias("date")).where("date is not null").distinct()
    number = F.row_number().over(Window.orderBy("date")).cast("string")
    return days.select(
        F.when(F.length(number) >= ERA_WIDTH, number)
        .otherwise(F.lpad(number, ERA_WIDTH, "0"))
        .alias("era"),
        "date",
    )


def custom_era_map(spark, path: str) -> DataFrame:
    """(era, date) from a CSV, eras padded, duplicates removed."""
    raw = spark.read.option("header", True).csv(path)
    if not {"era", "date"} <= set(raw.columns):
        raise ValueError("custom mapping must have columns era and date")
    number = F.col("era")
    return raw.select(
        F.when(F.length(number) >= ERA_WIDTH, number)
        .otherwise(F.lpad(number, ERA_WIDTH, "0"))
        .alias("era"),
        F.to_date("date").alias("date"),
    ).distinct()


def pct_change(prices: DataFrame, close: str = "close") -> DataFrame:
    """Adds ``ret`` against the previous day of the same ticker."""
    last = F.lag(close).over(Window.partitionBy("ticker").orderBy("date"))
    return prices.withColumn("ret", F.try_divide(F.col(close), last) - 1)


def zscore_return(returns: DataFrame) -> DataFrame:
    """Adds ``zret``: the return standardised over its ticker; no spread counts as 1."""
    stats = returns.groupBy("ticker").agg(
        F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_std")
    )
    std = F.when((F.col("_std") == 0), 1.0).otherwise(F.col("_std"))
    return (
        returns.join(bounded(stats), "ticker")
        .withColumn("zret", F.try_divide(F.col("ret") - F.col("_mean"), std))
        .drop("_mean", "_std")
    )


def era_ticker_features(
    prices: DataFrame,
    era_map: DataFrame,
    eras: DataFrame | None = None,
    kind: str = "ret",
    close: str = "close",
) -> DataFrame:
    """One column per ticker by era (``<ticker>_ret`` and so on), kept to the wanted eras."""
    if kind not in SUFFIX:
        raise ValueError(f"kind must be one of {sorted(SUFFIX)}")
    rows = prices.join(bounded(era_map), "date")
    if kind != "close":
        rows = pct_change(rows, close)
    if kind == "zscore":
        rows = zscore_return(rows)
    value = {"close": close, "zscore": "zret"}.get(kind, "ret")
    tickers = [r[0] for r in prices.select("ticker").distinct().orderBy("ticker").collect()]
    # an era with several days of one ticker keeps the first day
    cells = rows.groupBy("era", "ticker").agg(F.min_by(value, "date").alias("ret"))
    wide = cells.groupBy("era").pivot("ticker", tickers).agg(F.first("ret"))
    wide = wide.select("era", *[F.col(f"`{t}`").alias(f"{t}_{SUFFIX[kind]}") for t in tickers])
    if kind == "ensemble_ret":
        wide = wide.join(ensemble_return(cells), "era", "left")
    if eras is not None:
        padded = F.when(F.length("era") >= ERA_WIDTH, F.col("era")).otherwise(
            F.lpad(F.col("era"), ERA_WIDTH, "0")
        )
        wanted = eras.select(padded.alias("era")).distinct()
        wide = wide.join(wanted, "era", "right")
    return wide


def ensemble_return(returns: DataFrame) -> DataFrame:
    """(era, ensemble_ret): mean return over the tickers that have one."""
    return returns.groupBy("era").agg(F.avg("ret").alias("ensemble_ret"))


def pick_indicator(features: DataFrame) -> DataFrame:
    """(era, vix): the first volatility-index column, else the ensemble, else the first column."""
    names = [c for c in features.columns if c != "era"]
    volatility = [c for c in names if c.lower().startswith("^vix")]
    if volatility:
        pick = volatility[0]
    elif "ensemble_ret" in names:
        pick = "ensemble_ret"
    else:
        pick = names[0]
    return features.select("era", F.col(f"`{pick}`").alias("vix"))
