"""Queries for scans, schema operators, readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import market
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, sql
from panelspark.session import shared_dir
from panelspark.sources import files, panel as src

KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _row_order(*first: str):
    return [F.col(c) for c in [*first, *fx.KEYS, "feature_price", "feature_quantity"]]


ROW_ORDER_SQL = f"{KEY_SQL}, feature_price, feature_quantity"


@query(
    "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount FROM lineitem"
)
def scan_panel(spark, sf):
    return src.scan_panel(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    )


@query(
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')"
)
def scan_eras(spark, sf):
    return src.scan_eras(
        spark,
        f"{sf}/orders.parquet",
        ["1-URGENT", "3-MEDIUM"],
        ["o_orderpriority", "o_orderkey", "o_totalprice"],
        era="o_orderpriority",
    )


@query(sql("SELECT era, round(vix, 6) + 0.0 AS vix FROM indicator", "indicator"))
def read_indicator(spark, sf):
    path = shared_dir(spark, "indicator")
    fx.indicator(spark, sf).select("era", "vix").write.option("header", True).csv(path)
    return files.read_indicator(spark, path).select("era", r("vix").alias("vix"))


def _write_catalogue(spark, sf, wrap: str | None):
    """Distinct part types per brand as a JSON document; {feature_sets: ...} when wrapped."""
    part = fx.table(spark, sf, "part").select("p_brand", "p_type").distinct()
    sets = part.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_type")).alias("items"))
    doc = F.map_from_entries(F.collect_list(F.struct("p_brand", "items")))
    path = shared_dir(spark, "catalogue")
    body = F.struct(doc.alias(wrap)) if wrap else doc
    sets.agg(F.to_json(body).alias("value")).write.text(path)
    return path


@query(
    "SELECT shape, feature_set, cast(row_number() OVER (PARTITION BY shape, feature_set ORDER BY feature) - 1 AS int) AS pos, feature "
    "FROM (SELECT DISTINCT p_brand AS feature_set, p_type AS feature FROM part) "
    "CROSS JOIN (VALUES ('feature_sets'), ('map')) AS s(shape)"
)
def read_feature_sets(spark, sf):
    nested = files.read_feature_sets(spark, _write_catalogue(spark, sf, "feature_sets"))
    plain = files.read_feature_sets(spark, _write_catalogue(spark, sf, None))
    return nested.withColumn("shape", F.lit("feature_sets")).unionByName(
        plain.withColumn("shape", F.lit("map"))
    )


@query(
    sql(
        "SELECT era, feature_quantity, feature_price, feature_discount, target_gross, target_order FROM panel",
        "panel",
    )
)
def select_by_prefix(spark, sf):
    p = fx.panel(spark, sf)
    last = src.prefixed(p.columns, "target", 2, tail=True)
    return src.select_by_prefix(p, "feature", 3, keep=("era", *last))


@query(
    sql(
        "SELECT era, count(*) AS n, round(sum(feature_price), 4) + 0.0 AS feature_price, "
        "round(sum(feature_quantity), 4) + 0.0 AS feature_quantity FROM panel GROUP BY era",
        "panel",
    )
)
def align_features(spark, sf):
    train = fx.panel(spark, sf)
    valid = train.drop("feature_discount")
    wanted = ["feature_price", "feature_absent", "feature_discount", "feature_quantity", "target_net"]
    names = src.align_features(train, valid, wanted, "target_net")
    return valid.groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), *[r(F.sum(c), 4).alias(c) for c in names]
    )


@query(
    """
WITH base AS (SELECT DISTINCT p_type AS feature FROM part WHERE p_size <= 25),
new AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS pos FROM (SELECT DISTINCT p_type AS feature FROM part) t)
SELECT 'medium' AS feature_set, cast(row_number() OVER (ORDER BY feature) - 1 AS int) AS pos, feature FROM base
UNION ALL
SELECT 'medium', cast((SELECT count(*) FROM base) + row_number() OVER (ORDER BY pos) - 1 AS int), feature
FROM new WHERE feature NOT IN (SELECT feature FROM base)
"""
)
def merge_feature_sets(spark, sf):
    from pyspark.sql import Window

    part = fx.table(spark, sf, "part")

    def numbered(names):
        pos = (F.row_number().over(Window.orderBy("feature")) - 1).cast("int")
        return names.select(F.col("p_type").alias("feature")).distinct().withColumn("pos", pos)

    base = numbered(part.where("p_size <= 25")).withColumn("feature_set", F.lit("medium"))
    return files.merge_feature_sets(base, numbered(part))


@query(
    sql(
        f"SELECT era, {KEY_SQL} FROM panel ORDER BY era, {ROW_ORDER_SQL} LIMIT 1000",
        "panel",
    )
)
def limit_rows(spark, sf):
    return src.limit_rows(fx.panel(spark, sf), 1000, _row_order("era")).select("era", *fx.KEYS)


@query(
    sql(
        f"SELECT era, {KEY_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY {ROW_ORDER_SQL}) AS k "
        "FROM panel) WHERE k <= 5",
        "panel",
    )
)
def limit_rows_per_era(spark, sf):
    return src.limit_rows_per_era(fx.panel(spark, sf), 5, _row_order()).select("era", *fx.KEYS)


@query(
    sql(
        """
WITH sizes AS (SELECT era, era_idx, count(*) AS n FROM panel GROUP BY ALL),
seen AS (SELECT *, coalesce(sum(n) OVER (ORDER BY era_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM sizes)
SELECT 'first' AS mode, era, n FROM sizes WHERE era_idx <= 12
UNION ALL SELECT 'last', era, n FROM sizes WHERE era_idx > (SELECT max(era_idx) FROM sizes) - 6
UNION ALL SELECT 'rows', era, n FROM seen WHERE earlier < 1000
""",
        "panel",
    )
)
def restrict_eras(spark, sf):
    p = fx.panel(spark, sf)
    out = None
    for mode, kept in (
        ("first", src.restrict_eras(p, first=12)),
        ("last", src.restrict_eras(p, last=6)),
        ("rows", src.restrict_eras(p, within_rows=1000)),
    ):
        part = kept.groupBy("era").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    sql(
        "SELECT era, count(*) AS n, round(sum(feature_quantity), 4) + 0.0 AS quantity, "
        "round(sum(target_net), 4) + 0.0 AS net FROM panel GROUP BY era",
        "panel",
    )
)
def write_panel(spark, sf):
    path = shared_dir(spark, "panel")
    rows = fx.panel(spark, sf).select("era", "feature_quantity", "target_net")
    src.write_panel(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("era").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum("feature_quantity"), 4).alias("quantity"),
        r(F.sum("target_net"), 4).alias("net"),
    )


@query(
    "SELECT cast(row_number() OVER (ORDER BY o_orderkey) - 1 AS bigint) AS id, "
    "round(o_totalprice / 1000, 6) + 0.0 AS prediction FROM orders"
)
def write_predictions(spark, sf):
    path = shared_dir(spark, "predictions")
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("prediction")
    )
    src.write_predictions(rows, path, order=[F.col("o_orderkey")])
    back = spark.read.schema("id long, prediction double").option("header", True).csv(path)
    return back.select("id", r("prediction").alias("prediction"))


@query(
    sql(
        "SELECT shape, era, target_idx, round(w, 6) + 0.0 AS w FROM era_weights "
        "CROSS JOIN (VALUES ('flat'), ('nested'), ('listed')) AS s(shape)",
        "era_weights",
    )
)
def read_weights(spark, sf):
    from panelspark.operators.targets import tidy_to_arrays

    arrays = tidy_to_arrays(fx.era_weights(spark, sf))
    entry = F.collect_list(F.struct("era", "weights"))
    nested = F.collect_list(F.struct("era", F.struct("weights").alias("body")))
    out = None
    for shape, doc in (
        ("flat", F.map_from_entries(entry)),
        ("nested", F.map_from_entries(nested)),
        ("listed", entry),
    ):
        path = shared_dir(spark, f"weights-{shape}")
        arrays.agg(F.to_json(doc).alias("value")).write.text(path)
        part = files.read_weights(spark, path).select(
            F.lit(shape).alias("shape"), "era", F.posexplode("weights").alias("target_idx", "w")
        )
        out = part if out is None else out.unionByName(part)
    return out.select("shape", "era", "target_idx", r("w").alias("w"))


NARROW = ["l_orderkey", "l_linenumber", "l_partkey", "feature_quantity", "feature_discount", "era_idx"]


def _narrow_sql() -> str:
    parts = []
    for c in NARROW:
        if c.startswith("feature"):
            kind = "'float'"
        else:
            wide = "bigint" if c in ("l_orderkey", "l_partkey") else "int"
            kind = (
                f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
                f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
                f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE '{wide}' END"
            )
        parts.append(
            f"SELECT '{c}' AS name, {kind} AS type, round(min({c}), 4) + 0.0 AS low, "
            f"round(max({c}), 4) + 0.0 AS high FROM panel"
        )
    body = " UNION ALL ".join(parts)
    return sql(
        f"SELECT name, type, cast(low AS double) AS low, cast(high AS double) AS high FROM ({body})", "panel"
    )


@query(_narrow_sql())
def narrow_types(spark, sf):
    narrow = src.narrow_types(fx.panel(spark, sf).select(*NARROW))
    types = dict(narrow.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("name"),
            F.lit(types[c]).alias("type"),
            r(F.min(c), 4).alias("low"),
            r(F.max(c), 4).alias("high"),
        )
        for c in NARROW
    ]
    return narrow.agg(F.array(*cells).alias("c")).select(F.inline("c"))


@query(
    sql(
        "SELECT ticker, dt AS date, round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, "
        "round(close, 4) + 0.0 AS close, cast(volume AS bigint) AS volume FROM prices",
        "prices",
    )
)
def read_prices(spark, sf):
    path = shared_dir(spark, "prices")
    fx.prices(spark, sf).write.parquet(path)
    p = files.read_prices(spark, path)
    return p.select(
        "ticker",
        "date",
        r("Low", 4).alias("low"),
        r("High", 4).alias("high"),
        r("Close", 4).alias("close"),
        F.col("Volume").alias("volume"),
    )


PREVIOUS_SQL = "lag(close) OVER (PARTITION BY ticker ORDER BY dt)"


@query(
    sql(
        f"SELECT ticker, dt AS date, round(close / nullif({PREVIOUS_SQL}, 0) - 1, 6) + 0.0 AS ret FROM prices",
        "prices",
    )
)
def pct_change(spark, sf):
    return market.pct_change(fx.prices(spark, sf)).select("ticker", "date", r("ret").alias("ret"))


@query(
    sql(
        f"""
WITH returns AS (SELECT ticker, dt, close / nullif({PREVIOUS_SQL}, 0) - 1 AS ret FROM prices)
SELECT ticker, dt AS date, round((ret - avg(ret) OVER (PARTITION BY ticker))
       / coalesce(nullif(stddev_samp(ret) OVER (PARTITION BY ticker), 0), 1), 6) + 0.0 AS zret
FROM returns""",
        "prices",
    )
)
def zscore_return(spark, sf):
    z = market.zscore_return(market.pct_change(fx.prices(spark, sf)))
    return z.select("ticker", "date", r("zret").alias("zret"))


@query(
    sql(
        "SELECT lpad(cast(row_number() OVER (ORDER BY dt) AS varchar), 4, '0') AS era, dt AS date "
        "FROM (SELECT DISTINCT dt FROM prices)",
        "prices",
    )
)
def ordinal_era_map(spark, sf):
    return market.ordinal_era_map(fx.prices(spark, sf))


TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PIVOT_SQL = ", ".join(
    f"round(max(CASE WHEN ticker = '{t}' THEN ret END), 6) + 0.0 AS \"{t}_ret\"" for t in TICKERS
)


@query(
    sql(
        f"""
WITH days AS (SELECT lpad(cast(row_number() OVER (ORDER BY dt) AS varchar), 4, '0') AS era, dt
              FROM (SELECT DISTINCT dt FROM prices)),
returns AS (SELECT ticker, dt, close / nullif({PREVIOUS_SQL}, 0) - 1 AS ret FROM prices),
wide AS (SELECT era, {PIVOT_SQL}, round(avg(ret), 6) + 0.0 AS ensemble_ret FROM returns JOIN days USING (dt) GROUP BY era),
wanted AS (SELECT DISTINCT lpad(cast(dense_rank() OVER (ORDER BY l_shipdate::date) AS varchar), 4, '0') AS era FROM lineitem)
SELECT w.era, wide.* EXCLUDE (era) FROM wanted w LEFT JOIN wide USING (era)""",
        "prices",
    )
)
def era_ticker_features(spark, sf):
    """Daily returns per ticker by era, kept to the eras of a daily panel (right join)."""
    p = fx.prices(spark, sf)
    ship = fx.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"))
    wide = market.era_ticker_features(
        p, market.ordinal_era_map(p), market.ordinal_era_map(ship).select("era"), "ensemble_ret"
    )
    return wide.select("era", *[r(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "era"])


@query(
    sql(
        f"""
WITH days AS (SELECT lpad(cast(row_number() OVER (ORDER BY dt) AS varchar), 4, '0') AS era, dt
              FROM (SELECT DISTINCT dt FROM prices)),
returns AS (SELECT ticker, dt, close / nullif({PREVIOUS_SQL}, 0) - 1 AS ret FROM prices)
SELECT era, round(avg(ret), 6) + 0.0 AS vix FROM returns JOIN days USING (dt) GROUP BY era""",
        "prices",
    )
)
def market_indicator(spark, sf):
    p = fx.prices(spark, sf)
    wide = market.era_ticker_features(p, market.ordinal_era_map(p), None, "ensemble_ret")
    return market.pick_indicator(wide).select("era", r("vix").alias("vix"))
