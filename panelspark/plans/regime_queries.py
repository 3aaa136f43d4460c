"""Queries for regimes and the indicator."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import regimes as ops
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, sql
from panelspark.plans.source_queries import KEY_SQL


def _labels(spark, sf):
    return ops.label_by_level(fx.indicator(spark, sf))


@query(sql("SELECT era, round(vix, 6) + 0.0 AS vix, regime FROM regimes", "regimes"))
def regime_by_level(spark, sf):
    return _labels(spark, sf).select("era", r("vix").alias("vix"), "regime")


@query(
    sql(
        f"""
WITH j AS (SELECT p.*, i.vix FROM panel p LEFT JOIN indicator i USING (era)),
m AS (SELECT median(vix) AS middle FROM j)
SELECT era, {KEY_SQL}, round(coalesce(vix, middle), 6) + 0.0 AS vix,
       CASE WHEN vix IS NULL THEN 'unknown' WHEN vix > 25 THEN 'high_vol_crisis'
            WHEN vix < 15 THEN 'low_vol_grind' ELSE 'transition' END AS regime
FROM j CROSS JOIN m""",
        "panel",
        "indicator",
    )
)
def join_indicator(spark, sf):
    """Both treatments of eras without indicator: unknown label, and median fill."""
    p, i = fx.panel(spark, sf), fx.indicator(spark, sf)
    labelled = ops.join_regimes(p, ops.label_by_level(i))
    return ops.join_indicator(labelled, i, fill="median").select(
        "era", *fx.KEYS, r("vix").alias("vix"), "regime"
    )


PERCENTILE_SQL = """
SELECT a.era, count(*) AS n,
       (sum(CASE WHEN b.vix < a.vix THEN 1 ELSE 0 END) + (sum(CASE WHEN b.vix = a.vix THEN 1 ELSE 0 END) + 1) / 2.0)
       / count(*) * 100 AS percentile
FROM indicator a JOIN indicator b ON cast(b.era AS int) BETWEEN cast(a.era AS int) - {0} AND cast(a.era AS int)
GROUP BY a.era"""


@query(
    sql(
        f"SELECT era, round(percentile, 6) + 0.0 AS percentile FROM ({PERCENTILE_SQL.format(59)})",
        "indicator",
    )
)
def rolling_percentile(spark, sf):
    out = ops.rolling_percentile(fx.indicator(spark, sf), 60)
    return out.select("era", r("percentile").alias("percentile"))


@query(
    sql(
        f"""
SELECT era, CASE WHEN percentile >= 75 THEN 'high_vol_crisis' WHEN percentile <= 25 THEN 'low_vol_grind'
            ELSE 'transition' END AS regime FROM ({PERCENTILE_SQL.format(59)})""",
        "indicator",
    )
)
def regime_by_percentile(spark, sf):
    return ops.regime_by_percentile(fx.indicator(spark, sf)).select("era", "regime")


def _rolling_sql() -> str:
    windows = (5, 10, 20, 60)
    cols, joins = [], []
    for n in windows:
        w = f"OVER (ORDER BY era ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(
            f"round(avg(vix) {w}, 6) + 0.0 AS vix_mean_{n}d, "
            f"round(CASE WHEN count(*) {w} > 1 THEN stddev_samp(vix) {w} END, 6) + 0.0 AS vix_std_{n}d, "
            f"round(p{n}.percentile, 6) + 0.0 AS vix_percentile_{n}d"
        )
        joins.append(f"JOIN ({PERCENTILE_SQL.format(n - 1)}) p{n} USING (era)")
    return sql(f"SELECT era, {', '.join(cols)} FROM indicator {' '.join(joins)}", "indicator")


@query(_rolling_sql())
def rolling_features(spark, sf):
    out = ops.rolling_features(fx.indicator(spark, sf))
    return out.select("era", *[r(c).alias(c) for c in out.columns if c.startswith("vix_")])


@query(
    sql(
        "SELECT era, regime, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER (ORDER BY era) "
        "THEN 0 ELSE 1 END AS regime_changed FROM regimes",
        "regimes",
    )
)
def regime_changed(spark, sf):
    return ops.regime_changed(_labels(spark, sf)).select("era", "regime", "regime_changed")


@query(
    sql(
        """
WITH l AS (SELECT regime, lag(regime) OVER (ORDER BY era) AS prev FROM regimes)
SELECT prev || '_to_' || regime AS transition, count(*) AS n FROM l WHERE prev <> regime GROUP BY 1""",
        "regimes",
    )
)
def regime_transitions(spark, sf):
    return ops.regime_transitions(_labels(spark, sf))


@query(
    sql(
        """
SELECT regime, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) + 0.0 AS percentage,
       round(avg(vix), 6) + 0.0 AS vix_mean, round(stddev_samp(vix), 6) + 0.0 AS vix_std,
       round(min(vix), 6) + 0.0 AS vix_min, round(max(vix), 6) + 0.0 AS vix_max
FROM regimes GROUP BY regime""",
        "regimes",
    )
)
def regime_stats(spark, sf):
    out = ops.regime_stats(_labels(spark, sf))
    return out.select("regime", "n", *[r(c).alias(c) for c in out.columns[2:]])


@query(sql("SELECT regime, count(*) AS n FROM labelled GROUP BY regime", "labelled"))
def regime_distribution(spark, sf):
    return ops.regime_distribution(fx.labelled_panel(spark, sf))


@query(
    sql(
        "SELECT round(avg(vix), 6) + 0.0 AS mean, round(stddev_samp(vix), 6) + 0.0 AS std, "
        "round(min(vix), 6) + 0.0 AS min, round(max(vix), 6) + 0.0 AS max FROM indicator",
        "indicator",
    )
)
def indicator_stats(spark, sf):
    out = ops.indicator_stats(fx.indicator(spark, sf))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query(
    sql(
        "SELECT era, "
        + ", ".join(
            f"cast(regime = '{n}' AS int) AS regime_{n}"
            for n in ("high_vol_crisis", "low_vol_grind", "transition")
        )
        + " FROM regimes",
        "regimes",
    )
)
def one_hot_regime(spark, sf):
    return ops.one_hot_regime(_labels(spark, sf)).drop("vix", "regime")


SHORT_SQL = "CASE WHEN vix > 25 THEN 'crisis' WHEN vix < 15 THEN 'grind' WHEN vix IS NOT NULL THEN 'transition' END"


@query(
    sql(
        f"""
SELECT regime, count(*) AS n, round(avg(target_net), 6) + 0.0 AS mean_target
FROM (SELECT target_net, {SHORT_SQL} AS regime FROM labelled) WHERE regime IS NOT NULL GROUP BY regime""",
        "labelled",
    )
)
def regime_splits(spark, sf):
    p = ops.join_indicator(fx.panel(spark, sf), fx.indicator(spark, sf))
    out = None
    for name, rows in ops.regime_splits(p).items():
        part = rows.select(F.lit(name).alias("regime"), "target_net")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("target_net")).alias("mean_target")
    )


@query(
    sql(
        f"""
SELECT coalesce({SHORT_SQL}, 'transition') AS regime, count(*) AS n,
       round(avg(target_net), 6) + 0.0 AS mean_target FROM labelled GROUP BY 1""",
        "labelled",
    )
)
def purge_regimes(spark, sf):
    p = ops.join_indicator(fx.panel(spark, sf), fx.indicator(spark, sf))
    return ops.purge_regimes(p).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("target_net")).alias("mean_target")
    )


ERA_LISTS = {
    "crisis_2008": ["0010", "0011", "0012", "0013"],
    "covid_crash": ["0040", "0041", "0042", "0043"],
    "bear_market": ["0060", "0061", "0062"],
}


def _lists_sql() -> str:
    cases = " ".join(
        f"WHEN era IN ({', '.join(repr(e) for e in eras)}) THEN '{name}'"
        for name, eras in ERA_LISTS.items()
    )
    return sql(
        "SELECT regime, count(*) AS n "
        f"FROM (SELECT CASE {cases} ELSE 'normal_periods' END AS regime FROM panel) GROUP BY regime",
        "panel",
    )


@query(_lists_sql())
def purge_regimes_by_era(spark, sf):
    """Named era lists plus all other rows."""
    rows = ops.purge_regimes(fx.panel(spark, sf), era_lists=ERA_LISTS)
    return rows.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        "SELECT era, count(*) AS n, round(avg(target_net), 6) + 0.0 AS mean_target FROM panel WHERE era NOT IN ("
        + ", ".join(repr(e) for eras in ERA_LISTS.values() for e in eras)
        + ") GROUP BY era",
        "panel",
    )
)
def normal_periods(spark, sf):
    listed = [e for eras in ERA_LISTS.values() for e in eras]
    rows = ops.normal_periods(fx.panel(spark, sf), listed, None)
    return rows.groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("target_net")).alias("mean_target")
    )


BASE_SQL = """
SELECT era, vix, CASE WHEN vix > 25 THEN 0.7 WHEN vix < 15 THEN 0.1 ELSE 0.15 END AS bc,
       CASE WHEN vix > 25 THEN 0.1 WHEN vix < 15 THEN 0.7 ELSE 0.15 END AS bg,
       CASE WHEN vix > 25 OR vix < 15 THEN 0.2 ELSE 0.7 END AS bt FROM indicator"""


@query(
    sql(
        f"""
WITH perf AS (SELECT max(CASE WHEN regime = 'high_vol_crisis' THEN corr END) AS pc,
                     max(CASE WHEN regime = 'low_vol_grind' THEN corr END) AS pg,
                     max(CASE WHEN regime = 'transition' THEN corr END) AS pt
              FROM (SELECT regime, covar_pop(feature_flip, target_net) / nullif(stddev_pop(feature_flip) * stddev_pop(target_net), 0) AS corr
                    FROM labelled GROUP BY regime)),
v AS (SELECT era, greatest(0, bc * (1 + pc * 4)) AS c, greatest(0, bg * (1 + pg * 4)) AS g, greatest(0, bt * (1 + pt * 4)) AS t
      FROM ({BASE_SQL}) CROSS JOIN perf)
SELECT era, round(coalesce(c / nullif(c + g + t, 0), 0), 6) + 0.0 AS crisis,
       round(coalesce(g / nullif(c + g + t, 0), 0), 6) + 0.0 AS grind,
       round(coalesce(t / nullif(c + g + t, 0), 0), 6) + 0.0 AS transition FROM v""",
        "labelled",
        "indicator",
    )
)
def dynamic_weights(spark, sf):
    """Model weights per era; performance is four times each regime's flip correlation."""
    from panelspark.functions.correlation import pearson
    from panelspark.session import bounded

    corrs = bounded(pearson(fx.labelled_panel(spark, sf), ["regime"], "feature_flip", "target_net"))
    long = {"crisis": "high_vol_crisis", "grind": "low_vol_grind", "transition": "transition"}
    perf = {
        k: corrs.where(F.col("regime") == v).agg(F.max("corr") * 4).scalar() for k, v in long.items()
    }
    shares = expr.dynamic_weights(F.col("vix"), perf)
    return fx.indicator(spark, sf).select("era", *[r(c).alias(k) for k, c in shares.items()])


@query(
    sql(
        f"""
WITH l AS (SELECT *, {SHORT_SQL} AS short FROM labelled)
SELECT era, {KEY_SQL}, round(greatest(-1.0, least(1.0, feature_flip / 50000 * (feature_discount * 10)
       * CASE short WHEN 'crisis' THEN 0.5 WHEN 'transition' THEN 0.75 WHEN 'grind' THEN 1.0 ELSE 0.5 END)), 9) + 0.0 AS size
FROM l""",
        "labelled",
    )
)
def position_size(spark, sf):
    p = ops.join_indicator(fx.panel(spark, sf), fx.indicator(spark, sf))
    label = expr.regime_by_level(F.col("vix"), labels=expr.SHORT_LABELS)
    size = expr.position_size(
        F.col("feature_flip") / 50000, F.col("feature_discount") * 10, label
    )
    return p.select("era", *fx.KEYS, r(size, 9).alias("size"))
