"""Queries that go through whole runs: labels, tests, selection, new features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import fixtures as fx
from panelspark.plans import runs
from panelspark.plans.model_queries import SHORT_SQL
from panelspark.plans.regime_queries import PERCENTILE_SQL
from panelspark.plans.registry import query, r, spearman_sql, sql
from panelspark.plans.stability_queries import CANDIDATES, ENGINE_SQL, PURGE_SQL, TARGET


def _corrs_sql(features: list[str], view: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT regime, '{c}' AS feature, {i} AS pos, {c} AS value, target_net FROM {view}" for i, c in enumerate(features))
    return f"cells2 AS ({cells}), corrs2 AS ({spearman_sql('cells2', 'regime, feature, pos', 'value', 'target_net')})"


def _pairs(features: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in features for b in features if a != b]


def _stability_run_sql() -> str:
    ratios = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {a} / (abs({b}) + 1e-8::double) AS value, target_net FROM panel" for a, b in _pairs(CANDIDATES))
    return sql(f"""
WITH pct AS (SELECT era, CASE WHEN percentile >= 75 THEN 'high_vol_crisis' WHEN percentile <= 25 THEN 'low_vol_grind' ELSE 'transition' END AS regime
             FROM ({PERCENTILE_SQL.format(59)})),
named AS (SELECT p.*, coalesce(regime, 'unknown') AS regime FROM panel p LEFT JOIN pct USING (era)),
{_corrs_sql(CANDIDATES, "named")},
stable AS (SELECT feature, stability_score, row_number() OVER (ORDER BY stability_score DESC, pos) AS place
           FROM ({ENGINE_SQL.replace("regime_corrs", "corrs2")}) WHERE stable),
ratios AS ({ratios}),
scored AS (SELECT a, b, abs(corr) AS score FROM ({spearman_sql("ratios", "a, b", "value", "target_net")}) WHERE abs(corr) > 0.01)
SELECT feature, 'stable' AS kind, round(stability_score, 6) + 0.0 AS score FROM stable
UNION ALL SELECT * FROM (
  SELECT a || '_over_' || b AS feature, 'ratio' AS kind, round(score, 6) + 0.0 AS score
  FROM scored JOIN stable x ON x.feature = a JOIN stable y ON y.feature = b WHERE x.place < y.place
  ORDER BY scored.score DESC, x.place, y.place LIMIT 10)""", "panel", "indicator")


@query(_stability_run_sql())
def stability_run(spark, sf):
    """Regimes by percentile, verdicts, and the curated list with ratios of its features."""
    _, curated = runs.stability_run(fx.panel(spark, sf), fx.indicator(spark, sf), CANDIDATES, TARGET)
    return curated.select("feature", "kind", r("score").alias("score"))


def _purge_run_sql() -> str:
    features = fx.FEATURES
    plain = " UNION ALL ".join(f"SELECT '{f}' AS f, avg({f}) AS v FROM panel" for f in features)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, avg({a} / (abs({b}) + 1e-8::double)) AS ratio, avg({a} - {b}) AS diff FROM panel"
        for a, b in _pairs(features))
    rho = spearman_sql("whole", "feature", "value", "target_net")
    whole = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, target_net FROM panel" for f in features)
    tail = "split_part({0}, '_', -1)"
    number = "lpad(cast((i * (2 * n - 1 - i)) // 2 + j - i - 1 AS varchar), 2, '0')"
    return sql(f"""
WITH named AS (SELECT * EXCLUDE (regime), coalesce({SHORT_SQL}, 'transition') AS regime FROM labelled),
{_corrs_sql(features, "named")},
kept AS (SELECT feature, row_number() OVER (ORDER BY stability_score DESC, pos) - 1 AS place, count(*) OVER () AS n
         FROM ({PURGE_SQL.replace("regime_corrs", "corrs2")}) WHERE stable AND stability_score >= 0.01),
plain AS ({plain}), whole AS ({whole}), rho AS ({rho}),
pairs AS (SELECT p.*, x.place AS i, y.place AS j, x.n FROM ({pairs}) p JOIN kept x ON x.feature = a JOIN kept y ON y.feature = b WHERE x.place < y.place)
SELECT feature, round(v, 2) + 0.0 AS mean FROM kept JOIN plain ON f = feature
UNION ALL SELECT 'ratio_' || {tail.format("a")} || '_' || {tail.format("b")} || '_' || {number}, round(ratio / 1e6::double, 2) + 0.0 FROM pairs
UNION ALL SELECT 'diff_' || {tail.format("a")} || '_' || {tail.format("b")} || '_' || {number}, round(diff, 2) + 0.0 FROM pairs
UNION ALL SELECT feature || '_neutralized', round(v - 0.5 * corr * (SELECT avg(target_net) FROM panel), 2) + 0.0
FROM kept JOIN plain ON f = feature JOIN rho USING (feature) WHERE corr IS NOT NULL""", "labelled")


@query(_purge_run_sql())
def purge_run(spark, sf):
    """Every feature that the run ends with, and its mean over the panel that has them all (ratios, which near 0 are large, in millions)."""
    _, final, wide = runs.purge_run(fx.panel(spark, sf), fx.indicator(spark, sf), fx.FEATURES, TARGET)
    means = wide.agg(*[(F.avg(f) / (1e6 if f.startswith("ratio_") else 1.0)).alias(f) for f in final])
    return means.unpivot([], final, "feature", "mean").select("feature", r("mean", 2).alias("mean"))
