"""Queries for scores and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.correlation import pearson as pearson_by, spearman as spearman_by
from panelspark.operators import metrics as ops
from panelspark.operators import quality
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, spearman_sql, sql


def sanity_sql(source: str, groups: str, x: str) -> str:
    return f"""
SELECT b.*, mad, n_unique <= 1 OR range < 1e-12 OR std < 1e-12 OR mad < 1e-12 AS is_constant
FROM (SELECT {groups}, count(*) AS n, count(DISTINCT round({x}, 12)) AS n_unique, max({x}) - min({x}) AS range,
             coalesce(stddev_samp({x}), 0) AS std, avg({x}) AS mean FROM {source} GROUP BY {groups}) b
JOIN (SELECT {groups}, median(abs({x} - middle)) AS mad
      FROM (SELECT {groups}, {x}, median({x}) OVER (PARTITION BY {groups}) AS middle FROM {source}) GROUP BY {groups}) m
USING ({groups})"""


@query(
    sql(
        f"""
SELECT era, n, n_unique, round(range, 4) + 0.0 AS range, round(std, 4) + 0.0 AS std,
       round(mad, 4) + 0.0 AS mad, is_constant FROM ({sanity_sql("panel", "era", "target_order")})""",
        "panel",
    )
)
def era_sanity(spark, sf):
    out = ops.era_sanity(fx.panel(spark, sf), ["era"], "target_order")
    return out.select(
        "era", "n", "n_unique", *[r(c, 4).alias(c) for c in ("range", "std", "mad")], "is_constant"
    )


@query(
    sql(
        f"""
SELECT era, round(sharpe, 6) + 0.0 AS sharpe, reason FROM (
SELECT era, CASE WHEN is_constant THEN 'degenerate' WHEN std < 1e-9 AND mad < 1e-9 THEN 'zero_var_and_mad'
                 WHEN std < 1e-9 THEN 'robust' ELSE 'ok' END AS reason,
       CASE WHEN is_constant THEN NULL WHEN std < 1e-9 THEN mean / (1.4826 * mad + 1e-9) ELSE mean / (std + 1e-9) END AS sharpe
FROM ({sanity_sql("(SELECT era, CASE WHEN era_idx % 10 = 0 THEN 0.05 ELSE feature_discount END AS feature_discount FROM panel)", "era", "feature_discount")}))""",
        "panel",
    )
)
def safe_sharpe(spark, sf):
    """Every tenth era is made constant, hence degenerate."""
    p = fx.panel(spark, sf).withColumn(
        "feature_discount", F.when(F.col("era_idx") % 10 == 0, 0.05).otherwise(F.col("feature_discount"))
    )
    out = ops.safe_sharpe(p, ["era"], "feature_discount")
    return out.select("era", r("sharpe").alias("sharpe"), "reason")


ERA_CORRS_SQL = spearman_sql("predictions", "era", "prediction", "target")
IMPACT_SQL = "25 / 10000.0 / 0.15"


def sharpe_sql(source: str) -> str:
    return f"""
SELECT CASE WHEN stddev_samp(corr) > 0 THEN avg(corr) / stddev_samp(corr) ELSE 0 END AS sharpe_ratio,
       CASE WHEN stddev_samp(corr) > 0 THEN greatest(0, avg(corr) / stddev_samp(corr) - {IMPACT_SQL}) ELSE 0 END AS sharpe_with_tc,
       {IMPACT_SQL} AS tc_impact, avg(corr) AS mean_correlation, stddev_samp(corr) AS std_correlation,
       count(corr) AS n_eras FROM ({source})"""


@query(
    sql(
        "SELECT "
        + ", ".join(
            f"round({c}, 6) + 0.0 AS {c}"
            for c in ("sharpe_ratio", "sharpe_with_tc", "tc_impact", "mean_correlation", "std_correlation")
        )
        + f", n_eras FROM ({sharpe_sql(ERA_CORRS_SQL)})",
        "predictions",
    )
)
def realistic_sharpe(spark, sf):
    corrs = spearman_by(fx.predictions(spark, sf), ["era"], "prediction", "target")
    out = ops.realistic_sharpe(corrs, [], "corr")
    return out.select(*[r(c).alias(c) for c in out.columns if c != "n_eras"], "n_eras")


@query(
    sql(
        f"""
SELECT era, round(s, 6) + 0.0 AS sharpe, round(s - {IMPACT_SQL}, 6) + 0.0 AS sharpe_after_cost,
       round({IMPACT_SQL}, 6) + 0.0 AS tc_impact
FROM (SELECT era, CASE WHEN stddev_samp(prediction) > 0 THEN avg(prediction) / stddev_samp(prediction) ELSE 0 END AS s
      FROM predictions GROUP BY era)""",
        "predictions",
    )
)
def transaction_cost(spark, sf):
    out = ops.transaction_cost(fx.predictions(spark, sf), ["era"], "prediction")
    return out.select("era", *[r(c).alias(c) for c in out.columns[1:]])


@query(
    sql(
        """
SELECT era, count(*) AS n, round(coalesce(covar_pop(feature_quantity, target_gross) FILTER (ok)
       / nullif(stddev_pop(feature_quantity) FILTER (ok) * stddev_pop(target_gross) FILTER (ok), 0), 0), 6) + 0.0 AS corr
FROM (SELECT *, feature_quantity IS NOT NULL AND target_gross IS NOT NULL AS ok FROM gappy) GROUP BY era""",
        "gappy",
    )
)
def pearson(spark, sf):
    out = pearson_by(
        fx.gappy_panel(spark, sf), ["era"], "feature_quantity", "target_gross", missing=0.0
    )
    return out.select("era", "n", r("corr").alias("corr"))


@query(
    sql(f"SELECT era, n, round(corr, 6) + 0.0 AS corr FROM ({ERA_CORRS_SQL})", "predictions")
)
def spearman(spark, sf):
    out = spearman_by(fx.predictions(spark, sf), ["era"], "prediction", "target")
    return out.select("era", "n", r("corr").alias("corr"))


@query(
    sql(
        """
SELECT count(target_gross) AS n, round(avg(target_gross), 4) + 0.0 AS mean, round(stddev_pop(target_gross), 4) + 0.0 AS std,
       round(min(target_gross), 4) + 0.0 AS min, round(max(target_gross), 4) + 0.0 AS max FROM gappy""",
        "gappy",
    )
)
def finite_stats(spark, sf):
    out = ops.finite_stats(fx.gappy_panel(spark, sf), "target_gross")
    return out.select("n", *[r(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


def _quality_sql() -> str:
    targets = {"target_net": "target_net / 100000", "target_gross": "target_gross / 100000"}
    parts = [
        "SELECT 'eras_sequential' AS \"check\", cast(count(*) FILTER (cast(era AS int) <> k) AS double) AS value, count(*) FILTER (cast(era AS int) <> k) = 0 AS passed FROM sizes",
        "SELECT 'min_rows_per_era', cast(min(n) AS double), min(n) > 10 FROM sizes",
    ]
    corr = "abs(covar_pop({f}, t) / nullif(stddev_pop({f}) * stddev_pop(t), 0))"
    features = ["feature_quantity", "feature_discount", "feature_tax"]
    best = "greatest(" + ", ".join(corr.format(f=f) for f in features) + ")"
    parts.append(
        f"SELECT 'max_abs_correlation', {best}, {best} > 0.01 AND {best} < 0.99 FROM (SELECT *, target_net / 100000 AS t FROM panel)"
    )
    for name, e in targets.items():
        parts += [
            f"SELECT 'min_{name}', min({e}), min({e}) > -10 FROM panel",
            f"SELECT 'max_{name}', max({e}), max({e}) < 10 FROM panel",
            f"SELECT 'std_{name}', stddev_samp({e}), stddev_samp({e}) > 0.01 AND stddev_samp({e}) < 1 FROM panel",
            f"SELECT 'nulls_{name}', cast(count(*) FILTER ({e} IS NULL) AS double), count(*) FILTER ({e} IS NULL) = 0 FROM panel",
        ]
    return sql(
        "WITH sizes AS (SELECT era, count(*) AS n, row_number() OVER (ORDER BY era) AS k FROM panel GROUP BY era)\n"
        "SELECT \"check\", round(value, 6) + 0.0 AS value, passed FROM (" + " UNION ALL ".join(parts) + ")",
        "panel",
    )


@query(_quality_sql())
def panel_quality(spark, sf):
    p = fx.panel(spark, sf).withColumns(
        {t: F.col(t) / 100000 for t in ("target_net", "target_gross")}
    )
    out = quality.panel_quality(
        p,
        ["feature_quantity", "feature_discount", "feature_tax"],
        ["target_net", "target_gross"],
        "target_net",
    )
    return out.select("check", r("value").alias("value"), "passed")


SCOPED_SQL = """
SELECT scope, key, target, prediction FROM (
  SELECT 'overall' AS scope, 'all' AS key, target, prediction FROM scored
  UNION ALL SELECT 'era', era, target, prediction FROM scored
  UNION ALL SELECT 'regime', regime, target, prediction FROM scored)"""


@query(
    sql(
        f"""
WITH scored AS (SELECT p.*, coalesce(regime, 'unknown') AS regime FROM predictions p LEFT JOIN regimes USING (era)),
scoped AS ({SCOPED_SQL}),
corrs AS ({spearman_sql("scoped", "scope, key", "prediction", "target")}),
sharpe AS ({sharpe_sql("SELECT * FROM corrs WHERE scope = 'era' AND n > 1")})
SELECT metric, round(value, 6) + 0.0 AS value FROM (
  SELECT CASE WHEN scope = 'overall' THEN 'overall_correlation' ELSE 'corr_' || key END AS metric, corr AS value
  FROM corrs WHERE scope <> 'era'
  UNION ALL SELECT 'sharpe_ratio', sharpe_ratio FROM sharpe
  UNION ALL SELECT 'sharpe_with_tc', sharpe_with_tc FROM sharpe
  UNION ALL SELECT 'mean_correlation', mean_correlation FROM sharpe
  UNION ALL SELECT 'std_correlation', std_correlation FROM sharpe
  UNION ALL SELECT 'n_eras', n_eras FROM sharpe)""",
        "predictions",
        "regimes",
    )
)
def evaluate_predictions(spark, sf):
    from panelspark.operators.regimes import join_regimes, label_by_level

    p = join_regimes(fx.predictions(spark, sf), label_by_level(fx.indicator(spark, sf)))
    return ops.evaluate_predictions(p).select("metric", r("value").alias("value"))
