"""Queries for target blending and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import targets as ops
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, sql
from panelspark.plans.source_queries import KEY_SQL

OUT = ["era", *fx.KEYS]


def _weights(spark, sf, days=None):
    return ops.tidy_to_arrays(fx.era_weights(spark, sf, days))


def _out(df):
    return df.select(*OUT, r("adaptive_target").alias("adaptive_target"))


def _dot_sql(source: str, w: list[str], extra: str = "", views=("wide_weights",)) -> str:
    dot = f"target_net * {w[0]} + target_gross * {w[1]} + target_order * {w[2]}"
    return sql(
        f"{extra}SELECT era, {KEY_SQL}, round({dot}, 6) + 0.0 AS adaptive_target FROM {source}", *views
    )


@query(
    sql(
        f"""
WITH j AS (SELECT g.*, coalesce(w0, 1/3.0) AS w0, coalesce(w1, 1/3.0) AS w1, coalesce(w2, 1/3.0) AS w2
           FROM gappy g LEFT JOIN wide_weights w ON g.era = w.era),
m AS (SELECT *, CASE WHEN target_gross IS NULL THEN 0 ELSE w1 END AS v1, coalesce(target_gross, 0) AS t1 FROM j)
SELECT era, {KEY_SQL}, round((target_net * w0 + t1 * v1 + target_order * w2) / (w0 + v1 + w2), 6) + 0.0 AS adaptive_target
FROM m""",
        "gappy",
        "wide_weights",
    )
)
def adaptive_target(spark, sf):
    days = fx.calendar(spark, sf)
    return _out(ops.adaptive_target(fx.gappy_panel(spark, sf, days), _weights(spark, sf, days), fx.TARGETS))


# targets in name order: gross, net, order
NAME_ORDER_DOT = "target_gross * {0} + target_net * {1} + target_order * {2}"


@query(
    sql(
        f"""
WITH last AS (SELECT * FROM wide_weights ORDER BY era DESC LIMIT 5),
m AS (SELECT avg(w0) AS a0, avg(w1) AS a1, avg(w2) AS a2 FROM last)
SELECT p.era, {KEY_SQL}, round({NAME_ORDER_DOT.format("coalesce(w0, a0)", "coalesce(w1, a1)", "coalesce(w2, a2)")}, 6) + 0.0 AS adaptive_target
FROM panel p LEFT JOIN wide_weights w ON p.era = w.era CROSS JOIN m""",
        "wide_weights",
    )
)
def adaptive_target_per_era(spark, sf):
    days = fx.calendar(spark, sf)
    return _out(
        ops.adaptive_target_per_era(fx.panel(spark, sf, days=days), _weights(spark, sf, days), "ensemble", 5)
    )


@query(
    sql(
        f"""
WITH m AS (SELECT avg(w0) AS a0, avg(w1) AS a1, avg(w2) AS a2
           FROM (SELECT * FROM wide_weights ORDER BY era DESC LIMIT 7))
SELECT era, {KEY_SQL}, round({NAME_ORDER_DOT.format("a0", "a1", "a2")}, 6) + 0.0 AS adaptive_target
FROM panel CROSS JOIN m""",
        "wide_weights",
    )
)
def adaptive_target_ensemble(spark, sf):
    days = fx.calendar(spark, sf)
    return _out(ops.adaptive_target_ensemble(fx.panel(spark, sf, days=days), _weights(spark, sf, days), 7))


@query(
    sql(
        f"""
SELECT p.era, {KEY_SQL}, round(target_net * coalesce(w0, 1/3.0) + target_gross * coalesce(w1, 1/3.0)
       + target_order * coalesce(w2, 1/3.0), 6) + 0.0 AS adaptive_target
FROM panel p LEFT JOIN (SELECT * FROM wide_weights WHERE cast(era AS int) % 7 <> 0) w ON p.era = w.era""",
        "wide_weights",
    )
)
def adaptive_target_apply(spark, sf):
    """Vectors of every seventh era are too short and give way to equal weights."""
    days = fx.calendar(spark, sf)
    w = _weights(spark, sf, days)
    short = F.when(F.col("era").cast("int") % 7 == 0, F.slice("weights", 1, 2))
    w = w.withColumn("weights", F.coalesce(short, F.col("weights")))
    return _out(ops.adaptive_target_apply(fx.panel(spark, sf, days=days), w))


@query(
    sql(
        f"""
SELECT p.era, {KEY_SQL}, j.target_idx, round(coalesce(w.w, 1/3.0), 6) + 0.0 AS w
FROM panel p CROSS JOIN (VALUES (0), (1), (2)) AS j(target_idx)
LEFT JOIN era_weights w ON p.era = w.era AND w.target_idx = j.target_idx""",
        "era_weights",
    )
)
def join_weights(spark, sf):
    from panelspark.functions.expr import equal_weights

    days = fx.calendar(spark, sf)
    joined = ops.join_weights(fx.panel(spark, sf, days=days), _weights(spark, sf, days), equal_weights(3))
    return joined.select(*OUT, F.posexplode("weights").alias("target_idx", "w")).withColumn(
        "w", r("w")
    )


@query(
    sql(
        """
WITH k AS (SELECT *, dense_rank() OVER (ORDER BY era) > 20 AS found FROM era_weights)
SELECT target_idx, (['target_net', 'target_gross', 'target_order'])[target_idx + 1] AS target,
       round(avg(w), 6) + 0.0 AS mean_all, round(avg(w) FILTER (found), 6) + 0.0 AS mean_discovered,
       round(avg(cast(w > 1e-9 AS double)) FILTER (found), 6) + 0.0 AS active_share,
       round(coalesce(sum(w) FILTER (found) / nullif(count(*) FILTER (found AND w > 1e-9), 0), 0), 6) + 0.0 AS mean_when_active
FROM k GROUP BY target_idx""",
        "era_weights",
    )
)
def weight_report(spark, sf):
    out = ops.weight_report(_weights(spark, sf), fx.TARGETS, 20)
    names = ["mean_all", "mean_discovered", "active_share", "mean_when_active"]
    return out.select("target_idx", "target", *[r(c).alias(c) for c in names])


@query(
    sql(
        """
WITH l AS (SELECT *, lag(w0) OVER (ORDER BY era) AS b0, lag(w1) OVER (ORDER BY era) AS b1,
                  lag(w2) OVER (ORDER BY era) AS b2 FROM wide_weights)
SELECT era, round(CASE WHEN b0 IS NULL THEN 1 ELSE (w0*b0 + w1*b1 + w2*b2)
         / (sqrt(w0*w0 + w1*w1 + w2*w2) * sqrt(b0*b0 + b1*b1 + b2*b2)) END, 6) + 0.0 AS drift,
       round(1 / (w0*w0 + w1*w1 + w2*w2), 6) + 0.0 AS effective_targets FROM l""",
        "wide_weights",
    )
)
def weight_drift(spark, sf):
    out = ops.weight_drift(_weights(spark, sf))
    return out.select("era", r("drift").alias("drift"), r("effective_targets").alias("effective_targets"))
