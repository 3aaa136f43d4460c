"""Queries for feature stability, selection and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import stability as ops
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import query, r, spearman_sql, sql
from panelspark.session import bounded, written

TARGET = "target_net"
NUMBERS = ["magnitude_drop", "mean_correlation", "correlation_std", "stability_score"]


@query(
    sql(
        "SELECT regime, feature, n, round(corr, 6) + 0.0 AS corr FROM regime_corrs",
        "regime_corrs",
    )
)
def regime_correlations(spark, sf):
    out = ops.regime_correlations(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET)
    return out.select("regime", "feature", "n", r("corr").alias("corr"))


SUMMARY_SQL = """
SELECT feature, pos, count(*) AS n_regimes, count(DISTINCT sign(corr)) FILTER ({signed}) AS n_signs,
       max(abs(corr)) AS hi, min(abs(corr)) AS lo, avg(abs(corr)) AS mean_correlation,
       stddev_pop(corr) AS correlation_std
FROM regime_corrs WHERE n >= {rows} AND corr IS NOT NULL GROUP BY feature, pos"""


def _verdict_sql(signed: str, one_sign: str, strong: str, min_regimes: int) -> str:
    return f"""
SELECT feature, pos, n_regimes, hi, lo, mean_correlation, correlation_std,
       coalesce((hi - lo) / nullif(hi, 0), 0) AS magnitude_drop,
       mean_correlation * (1 - least(correlation_std, 1)) AS stability_score,
       n_regimes >= {min_regimes} AND {one_sign} AND coalesce((hi - lo) / nullif(hi, 0), 0) <= 0.5
         AND {strong} AS stable
FROM ({SUMMARY_SQL.format(signed=signed, rows=50)})"""


PURGE_SQL = _verdict_sql("abs(corr) > 0.01", "n_signs <= 1", "mean_correlation >= 0.005", 2)
ENGINE_SQL = _verdict_sql("TRUE", "n_signs = 1", "mean_correlation > 0.01", 1)
VERDICT_COLUMNS_SQL = "feature, pos, stable, n_regimes, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in NUMBERS
)


def _verdict(df):
    return df.select("feature", "pos", "stable", "n_regimes", *[r(c).alias(c) for c in NUMBERS])


def zero_based(df):
    return df.withColumn("pos", F.col("pos") - 1)


@query(sql(f"SELECT {VERDICT_COLUMNS_SQL} FROM ({PURGE_SQL})", "regime_corrs"))
def stability_purge(spark, sf):
    out = ops.stability_purge(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET)
    return _verdict(zero_based(out))


@query(sql(f"SELECT {VERDICT_COLUMNS_SQL} FROM ({ENGINE_SQL})", "regime_corrs"))
def stability_engine(spark, sf):
    out = ops.stability_engine(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET)
    return _verdict(zero_based(out))


SIMPLE_SQL = f"""
SELECT feature, pos, n_signs > 1 AS sign_flip, coalesce(1 - lo / nullif(hi, 0), 1) AS drop_size,
       n_signs <= 1 AND coalesce(1 - lo / nullif(hi, 0), 1) <= 0.5 AS stable
FROM ({SUMMARY_SQL.format(signed="TRUE", rows=0)})"""


@query(
    sql(
        f"SELECT feature, pos, stable, sign_flip, round(drop_size, 6) + 0.0 AS drop_size FROM ({SIMPLE_SQL})",
        "regime_corrs",
    )
)
def stability_simple(spark, sf):
    out = zero_based(ops.stability_simple(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET))
    return out.select("feature", "pos", "stable", "sign_flip", r("drop").alias("drop_size"))


@query(
    sql(
        f"SELECT feature, round(stability_score, 6) + 0.0 AS score FROM ({PURGE_SQL}) "
        "WHERE stable AND stability_score >= 0.01 ORDER BY stability_score DESC, pos LIMIT 200",
        "regime_corrs",
    )
)
def select_survivors(spark, sf):
    verdicts = ops.stability_purge(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET)
    return ops.select_survivors(verdicts).select("feature", r("stability_score").alias("score"))


# A wider candidate list, so that several features are stable and pairs exist.
CANDIDATES = ["feature_price", "target_gross", "feature_discount", "feature_flip", "target_order"]


def _candidate_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT regime, '{c}' AS feature, {i} AS pos, {c} AS value, target_net FROM labelled"
        for i, c in enumerate(CANDIDATES)
    )
    corrs = spearman_sql("cells2", "regime, feature, pos", "value", "target_net")
    return f"cells2 AS ({cells}), corrs2 AS ({corrs})"


CANDIDATE_ENGINE_SQL = ENGINE_SQL.replace("regime_corrs", "corrs2")


def _ratio_sql() -> str:
    """All ratios of candidate pairs that are stable, ranked by their correlation."""
    parts = []
    for i, a in enumerate(CANDIDATES):
        for j, b in enumerate(CANDIDATES):
            if i < j:
                parts.append(
                    f"SELECT '{a}_over_{b}' AS feature, '{a}' AS numerator, '{b}' AS denominator, "
                    f"{a} / (abs({b}) + 1e-8) AS value, target_net FROM panel"
                )
    ratios = " UNION ALL ".join(parts)
    corrs = spearman_sql("ratios", "feature, numerator, denominator", "value", "target_net")
    return f"""
stable AS (SELECT feature FROM ({CANDIDATE_ENGINE_SQL}) WHERE stable),
ratios AS ({ratios}),
chosen AS (SELECT feature, numerator, denominator, abs(corr) AS score FROM ({corrs})
           WHERE numerator IN (FROM stable) AND denominator IN (FROM stable) AND abs(corr) > 0.01
           ORDER BY abs(corr) DESC, feature LIMIT 10)"""


def _stable_names(verdicts) -> list[str]:
    ranked = verdicts.where("stable").orderBy("pos")
    return [x["feature"] for x in ranked.select("feature", "pos").collect()]


@query(
    sql(
        f"WITH {_candidate_sql()}, {_ratio_sql()} "
        "SELECT feature, numerator, denominator, round(score, 6) + 0.0 AS score FROM chosen",
        "labelled",
    )
)
def select_ratios(spark, sf):
    p = written(fx.labelled_panel(spark, sf).select("era", "regime", *CANDIDATES, TARGET), "panel")
    verdicts = bounded(ops.stability_engine(p, CANDIDATES, TARGET))
    out = ops.select_ratios(p, _stable_names(verdicts), TARGET)
    return out.select("feature", "numerator", "denominator", r("score").alias("score"))


WIDE = 64
WIDE_RATIO_SQL = spearman_sql("cells", "i, j", "value", "y")


@query(
    sql(
        f"""
WITH cells AS (
  SELECT i, j, features[i + 1] / (abs(features[j + 1]) + 1e-8::double) AS value, features[1] - features[{WIDE}] AS y
  FROM vectors, unnest(range({WIDE})) AS a(i), unnest(range({WIDE})) AS b(j) WHERE i < j),
ranked AS (SELECT i, j, abs(corr) AS score FROM ({WIDE_RATIO_SQL}) WHERE abs(corr) > 0.01)
SELECT 'feature_' || i || '_over_feature_' || j AS feature, 'feature_' || i AS numerator,
       'feature_' || j AS denominator, round(score, 6) + 0.0 AS score
FROM ranked ORDER BY ranked.score DESC, i, j LIMIT 200""",
        "vectors",
    )
)
def select_ratios_wide(spark, sf):
    """All 2,016 ratios of 64 features, the best 200 of them."""
    v = fx.vector_panel(spark, sf, WIDE)
    names = [f"feature_{i}" for i in range(WIDE)]
    v = v.select(*names, (F.col("feature_0") - F.col(f"feature_{WIDE - 1}")).alias("y"))
    out = ops.select_ratios(v, names, "y", limit=200)
    return out.select("feature", "numerator", "denominator", r("score").alias("score"))


@query(
    sql(
        f"""
WITH {_candidate_sql()}, {_ratio_sql()}
SELECT feature, kind, round(score, 6) + 0.0 AS score FROM (
  SELECT feature, 'stable' AS kind, stability_score AS score FROM ({CANDIDATE_ENGINE_SQL}) WHERE stable
  UNION ALL SELECT feature, 'ratio', score FROM chosen)""",
        "labelled",
    )
)
def curate_features(spark, sf):
    """End to end: regimes, rank correlations, verdicts, ratios, curated list."""
    p = written(fx.labelled_panel(spark, sf).select("era", "regime", *CANDIDATES, TARGET), "panel")
    verdicts = bounded(ops.stability_engine(p, CANDIDATES, TARGET))  # one row per feature
    ratios = ops.select_ratios(p, _stable_names(verdicts), TARGET)
    return ops.curate_features(verdicts, ratios).select("feature", "kind", r("score").alias("score"))


@query(
    sql(
        f"SELECT feature, pos FROM ({SIMPLE_SQL}) WHERE stable ORDER BY pos LIMIT 50",
        "regime_corrs",
    )
)
def curate_simple(spark, sf):
    out = ops.stability_simple(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET)
    return zero_based(ops.curate_simple(out))


@query(
    sql(
        f"""
WITH v AS ({PURGE_SQL}), s AS (SELECT count(*) AS k FROM v WHERE stable AND stability_score >= 0.01)
SELECT (SELECT count(DISTINCT feature) FROM cells) AS total_candidates, count(*) FILTER (stable) AS stable_features,
       cast(max(k) AS bigint) AS survivor_features, cast(3 AS bigint) AS engineered_features,
       cast(max(k) + 3 AS bigint) AS final_features,
       round(coalesce(avg(stability_score) FILTER (stable), 0), 6) + 0.0 AS average_stability_score,
       round((max(k) + 3) / cast((SELECT count(DISTINCT feature) FROM cells) AS double), 6) + 0.0 AS survival_rate
FROM v CROSS JOIN s""",
        "regime_corrs",
    )
)
def curation_summary(spark, sf):
    verdicts = bounded(ops.stability_purge(fx.labelled_panel(spark, sf), fx.FEATURES, TARGET))
    survivors = ops.select_survivors(verdicts).count()
    out = ops.curation_summary(verdicts, survivors, 3)
    rounded = {"average_stability_score", "survival_rate"}
    return out.select(*[r(c).alias(c) if c in rounded else c for c in out.columns])
