"""Readers for the small side tables: indicator, feature sets, weights, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns a price history must have.
PRICE_COLUMNS = ("date", "Open", "High", "Low", "Close", "Volume")


def read_indicator(spark: SparkSession, path: str) -> DataFrame:
    """``era,vix`` CSV with the era as text."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"era", "vix"} - set(raw.columns)
    if missing:
        raise ValueError(f"indicator file lacks columns {sorted(missing)}")
    return raw.select(
        F.col("era").cast("string").alias("era"), F.col("vix").try_cast("double").alias("vix")
    )


def _whole_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))


def read_feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """(feature_set, pos, feature) from any of the four catalogue shapes.

    A list, ``{features: [...]}``, ``{feature_sets: {...}}`` or a map of lists, of
    which ``targets`` is not a set. Items are names or objects with a ``name``.
    """
    doc = _whole_json(spark, path)
    is_list = F.substring(F.ltrim("doc"), 1, 1) == "["
    sets = doc.select(
        F.when(is_list, F.col("doc")).alias("listed"),
        F.when(~is_list, F.from_json("doc", "map<string,string>")).alias("m"),
    )
    one = F.lit("features")
    nested = F.from_json(F.col("m")["feature_sets"], "map<string,string>")
    entries = sets.select(
        F.when(F.col("listed").isNotNull(), F.create_map(one, F.col("listed")))
        .when(F.map_contains_key("m", F.lit("features")), F.create_map(one, F.col("m")["features"]))
        .when(F.map_contains_key("m", F.lit("feature_sets")), nested)
        .otherwise(F.map_filter("m", lambda k, v: k != "targets"))
        .alias("sets")
    )
    items = entries.select(F.explode("sets").alias("feature_set", "items")).select(
        "feature_set", F.posexplode(F.from_json("items", "array<string>")).alias("pos", "item")
    )
    named = F.get_json_object("item", "$.name")
    return items.select(
        "feature_set",
        "pos",
        F.when(F.col("item").startswith("{"), named).otherwise(F.col("item")).alias("feature"),
    ).where(F.col("feature").isNotNull())


def merge_feature_sets(base: DataFrame, new: DataFrame, into: str = "medium") -> DataFrame:
    """Appends names not yet in one set, after its last position, in their own order."""
    held = base.where(F.col("feature_set") == into)
    fresh = new.join(held.select("feature"), "feature", "left_anti")
    first = fresh.groupBy("feature").agg(F.min("pos").alias("pos"))
    start = F.coalesce(held.agg(F.max("pos") + 1).scalar(), F.lit(0))
    added = first.select(
        F.lit(into).alias("feature_set"),
        (start + F.row_number().over(Window.orderBy("pos")) - 1).cast("int").alias("pos"),
        "feature",
    )
    return base.select("feature_set", "pos", "feature").unionByName(added)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(era, weights) from ``{era: [w]}``, ``{era: {weights: [w]}}`` or ``[{era, weights}]``."""
    doc = _whole_json(spark, path)
    record = "array<struct<era:string,weights:array<double>>>"
    is_list = F.substring(F.ltrim("doc"), 1, 1) == "["
    listed = doc.where(is_list).select(F.inline(F.from_json("doc", record)))
    keyed = doc.where(~is_list).select(
        F.explode(F.from_json("doc", "map<string,string>")).alias("era", "body")
    )
    nested = F.from_json("body", "struct<weights:array<double>>")["weights"]
    flat = F.from_json("body", "array<double>")
    is_object = F.substring(F.ltrim("body"), 1, 1) == "{"
    return listed.unionByName(
        keyed.select("era", F.when(is_object, nested).otherwise(flat).alias("weights"))
    )


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Daily price history; fails early when a needed column is absent."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    missing = [c for c in PRICE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"price history lacks columns {missing}")
    extra = [c for c in raw.columns if c not in PRICE_COLUMNS]
    return raw.select(
        *extra,
        F.col("date").cast(T.DateType()).alias("date"),
        *[F.col(c).cast("double").alias(c) for c in PRICE_COLUMNS[1:5]],
        F.col("Volume").cast("double").cast("long").alias("Volume"),
    )
