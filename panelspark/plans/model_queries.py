"""Queries for models, validation and live monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.functions.correlation import spearman
from panelspark.operators import boosting
from panelspark.operators import models as ops
from panelspark.operators.metrics import evaluate_predictions
from panelspark.plans import fixtures as fx
from panelspark.plans.metric_queries import IMPACT_SQL
from panelspark.plans.registry import query, r, spearman_sql, sql
from panelspark.plans.split_queries import _splits_sql
from panelspark.session import shared_dir, written
from panelspark.streaming import monitor

FEATURE, TARGET = "feature_quantity", "target_net"
SHORT_SQL = (
    "CASE WHEN vix > 25 THEN 'crisis' WHEN vix < 15 THEN 'grind' WHEN vix IS NOT NULL THEN 'transition' END"
)


@query(
    sql(
        f"""
SELECT regime, count(*) AS n, round(regr_intercept({TARGET}, {FEATURE}), 6) + 0.0 AS intercept,
       round(regr_slope({TARGET}, {FEATURE}), 6) + 0.0 AS slope
FROM (SELECT * EXCLUDE (regime), {SHORT_SQL} AS short FROM labelled), (VALUES ('all')) AS a(whole), unnest([whole, short]) AS u(regime)
WHERE regime IS NOT NULL GROUP BY regime""",
        "labelled",
    )
)
def linear_fit(spark, sf):
    """One model over all rows and one per regime, in one pass."""
    p = fx.labelled_panel(spark, sf)
    short = F.when(F.col("vix") > 25, "crisis").when(F.col("vix") < 15, "grind").when(
        F.col("vix").isNotNull(), "transition"
    )
    rows = p.withColumn("regime", F.explode(F.array(F.lit("all"), short))).where(
        F.col("regime").isNotNull()
    )
    out = ops.linear_fit(rows, [FEATURE], TARGET, ["regime"])
    return out.select("regime", "n", r("intercept").alias("intercept"), r(F.col("coef")[0]).alias("slope"))


def _linear_sql() -> str:
    return sql(
        f"""
WITH m AS (SELECT regime, regr_intercept({TARGET}, {FEATURE}) AS a, regr_slope({TARGET}, {FEATURE}) AS b FROM labelled GROUP BY regime)
SELECT era, count(*) AS n, round(avg(a + b * {FEATURE}), 6) + 0.0 AS mean_prediction
FROM labelled JOIN m USING (regime) GROUP BY era""",
        "labelled",
    )


@query(_linear_sql())
def linear_predict(spark, sf):
    p = fx.labelled_panel(spark, sf)
    model = ops.linear_fit(p, [FEATURE], TARGET, ["regime"])
    scored = ops.linear_predict(p, model, [FEATURE], ["regime"])
    return scored.groupBy("era").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("prediction")).alias("mean_prediction")
    )


def _honesty_sql(rows: str, keys: str) -> str:
    """Train and test rank correlation of a fit on x and z, drop and honesty, per key."""
    corrs = spearman_sql("hscored", f"{keys}, role", "p", "y")
    return f"""
hrows AS ({rows}),
hsums AS (SELECT {keys}, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy,
                 avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM hrows WHERE role = 'train' GROUP BY {keys}),
hcoefs AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c FROM hsums),
hmodel AS (SELECT {keys}, my - b * mx - c * mz AS a, b, c FROM hcoefs),
hscored AS (SELECT {keys}, role, a + (b * x + c * z) AS p, y FROM hrows JOIN hmodel USING ({keys})),
hcorrs AS ({corrs}),
hwide AS (SELECT {keys}, max(corr) FILTER (role = 'train') AS train_correlation, max(corr) FILTER (role = 'val') AS test_correlation
          FROM hcorrs GROUP BY {keys}),
honesty AS (SELECT *, CASE WHEN train_correlation <> 0 AND test_correlation IS NOT NULL THEN 1 - test_correlation / train_correlation ELSE 'Infinity'::double END AS drop_size,
            CASE WHEN train_correlation <> 0 AND 1 - test_correlation / train_correlation <= 0.5
                 THEN greatest(0, least(1, test_correlation / train_correlation)) ELSE 0 END AS honesty FROM hwide)"""


HONESTY_COLUMNS = ["train_correlation", "test_correlation", "drop_size", "honesty"]
HONESTY_OUT_SQL = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in HONESTY_COLUMNS)


@query(
    sql(
        "WITH "
        + _honesty_sql(
            f"SELECT 0 AS run, CASE WHEN era_idx <= 30 THEN 'train' ELSE 'val' END AS role, feature_discount AS x, feature_tax AS z, {TARGET} AS y "
            "FROM panel WHERE era_idx <= 30 OR era_idx >= 45",
            "run",
        )
        + f" SELECT {HONESTY_OUT_SQL} FROM honesty",
        "panel",
    )
)
def time_machine_test(spark, sf):
    p = fx.panel(spark, sf)
    out = ops.time_machine_test(
        p.where("era_idx <= 30"), p.where("era_idx >= 45"), ["feature_discount", "feature_tax"], TARGET, 15
    ).withColumnRenamed("drop", "drop_size")
    return out.select(*[r(c).alias(c) for c in HONESTY_COLUMNS])


def _folds_body() -> tuple[str, str]:
    """The daily splits query cut into its WITH list and its final SELECT."""
    text = _splits_sql("day_panel", 5, 200)
    head, tail = text.split("\nSELECT fold, 'train'", 1)
    return head, f"SELECT fold, 'train'{tail}"


def _cv_sql(final: str) -> str:
    head, tail = _folds_body()
    rows = (
        f"SELECT fold, role, s.era, s.era_idx, p.feature_discount AS x, p.feature_tax AS z, p.{TARGET} AS y FROM day_panel p JOIN splits s ON p.era = s.era"
    )
    scoped = """
SELECT fold, 'overall' AS scope, 'all' AS key, p, y FROM val
UNION ALL SELECT fold, 'era', era, p, y FROM val
UNION ALL SELECT fold, 'regime', CASE era_idx % 3 WHEN 0 THEN 'crisis' WHEN 1 THEN 'grind' ELSE 'transition' END, p, y FROM val"""
    return f"""{head},
splits AS ({tail}),
{_honesty_sql(rows, "fold")},
val AS (SELECT fold, era, era_idx, a + (b * x + c * z) AS p, y FROM hrows JOIN hmodel USING (fold) WHERE role = 'val'),
scoped AS ({scoped}),
vcorrs AS ({spearman_sql("scoped", "fold, scope, key", "p", "y")}),
sharpe AS (SELECT fold, CASE WHEN stddev_samp(corr) > 0 THEN avg(corr) / stddev_samp(corr) ELSE 0 END AS s, avg(corr) AS m,
                  stddev_samp(corr) AS sd, count(corr) AS k FROM vcorrs WHERE scope = 'era' AND n > 1 GROUP BY fold),
metrics AS (SELECT fold, 'overall_correlation' AS metric, corr AS value FROM vcorrs WHERE scope = 'overall'
  UNION ALL SELECT fold, 'corr_' || key, corr FROM vcorrs WHERE scope = 'regime'
  UNION ALL SELECT fold, 'sharpe_ratio', s FROM sharpe
  UNION ALL SELECT fold, 'sharpe_with_tc', greatest(0, s - {IMPACT_SQL}) FROM sharpe
  UNION ALL SELECT fold, 'mean_correlation', m FROM sharpe
  UNION ALL SELECT fold, 'std_correlation', sd FROM sharpe
  UNION ALL SELECT fold, 'n_eras', k FROM sharpe)
{final}"""


def _validated(spark, sf) -> dict:
    p = fx.day_panel(spark, sf)
    names = F.array(*map(F.lit, ("crisis", "grind", "transition")))
    p = p.withColumn("regime", names[F.col("era_idx") % 3])
    return ops.cross_validate(p, ["feature_discount", "feature_tax"], TARGET, 5, 200)


@query(_cv_sql("SELECT fold, metric, round(value, 6) + 0.0 AS value FROM metrics"))
def cross_validate(spark, sf):
    return _validated(spark, sf)["metrics"].withColumn("value", r("value"))


@query(
    _cv_sql(
        "SELECT metric, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, count(value) AS n "
        "FROM metrics WHERE value IS NOT NULL GROUP BY metric"
    )
)
def fold_summary(spark, sf):
    out = _validated(spark, sf)["summary"]
    return out.select("metric", r("mean").alias("mean"), r("std").alias("std"), "n")


@query(
    _cv_sql(
        "SELECT round(coalesce(avg(train_correlation), 0), 6) + 0.0 AS avg_train_corr, "
        "round(coalesce(avg(test_correlation), 0), 6) + 0.0 AS avg_test_corr, "
        "round(coalesce(avg(drop_size), 0), 6) + 0.0 AS avg_drop, round(coalesce(avg(honesty), 0), 6) + 0.0 AS honesty_score, "
        "count(*) AS n_tests, coalesce(avg(honesty), 0) > 0.8 AS honest FROM honesty"
    )
)
def time_machine_summary(spark, sf):
    out = _validated(spark, sf)["honesty"]
    names = ["avg_train_corr", "avg_test_corr", "avg_drop", "honesty_score"]
    return out.select(*[r(c).alias(c) for c in names], "n_tests", "honest")


@query(
    """
SELECT model, count(*) AS n, round(covar_pop(prediction, o_totalprice) / (stddev_pop(prediction) * stddev_pop(o_totalprice)), 6) + 0.0 AS corr
FROM (SELECT 'control' AS model, o_orderkey AS id, o_custkey * 1.0::double AS prediction FROM orders
      UNION ALL SELECT 'experimental', o_orderkey, o_custkey + o_totalprice / 100 FROM orders) p
JOIN orders o ON o.o_orderkey = p.id GROUP BY model"""
)
def compare_models(spark, sf):
    o = fx.table(spark, sf, "orders")
    key = F.col("o_orderkey").alias("id")
    control = o.select(key, F.col("o_custkey").cast("double").alias("prediction"))
    other = o.select(key, (F.col("o_custkey") + F.col("o_totalprice") / 100).alias("prediction"))
    valid = o.select(key, F.col("o_totalprice").alias("target"))
    out = ops.compare_models({"control": control, "experimental": other}, valid)
    return out.select("model", "n", r("corr").alias("corr"))


@query(
    "SELECT a.o_orderkey AS id, cast(a.o_custkey AS double) AS prediction, b.o_totalprice AS target "
    "FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey"
)
def join_predictions(spark, sf):
    o = fx.table(spark, sf, "orders")
    key = F.col("o_orderkey").alias("id")
    return ops.join_predictions(
        o.select(key, F.col("o_custkey").cast("double").alias("prediction")),
        o.select(key, F.col("o_totalprice").alias("target")),
    )


GBT_FEATURES = ["feature_quantity", "feature_discount", "feature_tax", "feature_flip"]


@query()
def train_ensemble(spark, sf):
    """Five seeds of a hundred rounds on all rows, scored per era."""
    p = fx.panel(spark, sf)
    scored = ops.predict_ensemble(p, ops.train_ensemble(p, GBT_FEATURES, TARGET), GBT_FEATURES)
    # written once: ranks and ranges would each score the rows anew
    return spearman(written(scored.select("era", "prediction", TARGET), "scored-rows"), ["era"], "prediction", TARGET)


@query()
def train_by_regime(spark, sf):
    """Fifty rounds for every regime on all rows, scored overall, per era and per regime."""
    p = fx.labelled_panel(spark, sf)
    scored = ops.predict_by_regime(p, ops.train_by_regime(p, GBT_FEATURES, TARGET), GBT_FEATURES)
    return evaluate_predictions(scored, target=TARGET)


# Stumps on features whose values all have a bin of their own, without sampling: SQL can follow them.
STUMP_FEATURES = ["feature_discount", "feature_quantity"]
STUMPS = boosting.Settings(rounds=3, depth=1, step=0.05, row_share=1.0, feature_share=1.0)


def _stump_sql(view: str, segment: str) -> str:
    parts = [f"""
f0 AS (SELECT era, seg, x0, x1, y, avg(y) OVER (PARTITION BY seg) AS f FROM (
  SELECT era, {segment} AS seg, {STUMP_FEATURES[0]} AS x0, {STUMP_FEATURES[1]} AS x1, {TARGET} AS y FROM {view})
  QUALIFY seg IS NOT NULL AND count(*) OVER (PARTITION BY seg) >= 100)"""]
    for k in range(STUMPS.rounds):
        parts.append(f"""
h{k} AS (SELECT seg, j, v, sum(d) AS s, count(*) AS n FROM (
  SELECT seg, 0 AS j, x0 AS v, y - f AS d FROM f{k} UNION ALL SELECT seg, 1, x1, y - f FROM f{k}) GROUP BY seg, j, v),
e{k} AS (SELECT *, sum(s) OVER upto AS sl, sum(n) OVER upto AS nl, sum(s) OVER whole AS st, sum(n) OVER whole AS nt FROM h{k}
  WINDOW upto AS (PARTITION BY seg, j ORDER BY v), whole AS (PARTITION BY seg, j)),
b{k} AS (SELECT * FROM e{k} WHERE nl >= 20 AND nt - nl >= 20 QUALIFY row_number() OVER (
  PARTITION BY seg ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt DESC, j, v) = 1),
f{k + 1} AS (SELECT era, seg, x0, x1, y, f + 0.05 * CASE WHEN CASE j WHEN 0 THEN x0 ELSE x1 END <= v THEN sl / nl ELSE (st - sl) / (nt - nl) END AS f
  FROM f{k} JOIN b{k} USING (seg))""")
    return sql("WITH " + ",".join(parts) + f"""
SELECT era, seg AS regime, count(*) AS n, round(avg(f), 4) + 0.0 AS mean_prediction, round(max(f), 4) + 0.0 AS max_prediction
FROM f{STUMPS.rounds} GROUP BY era, seg""", view)


def _predicted(scored, segment):
    return scored.where(segment.isNotNull()).groupBy("era", segment.alias("regime")).agg(
        F.count("*").alias("n"), r(F.avg("prediction"), 4).alias("mean_prediction"),
        r(F.max("prediction"), 4).alias("max_prediction"))


def _written(p, *more):
    """The panel's columns of stumps: training and scoring would each work them out.

    Stumps draw no rows, whose numbers depend on the files they are read from.
    """
    return written(p.select("era", *STUMP_FEATURES, TARGET, *more), "panel-rows")


@query(_stump_sql("panel", "'all'"))
def train_ensemble_stumps(spark, sf):
    p = _written(fx.panel(spark, sf))
    fitted = ops.train_ensemble(p, STUMP_FEATURES, TARGET, [42, 43], STUMPS)
    return _predicted(ops.predict_ensemble(p, fitted, STUMP_FEATURES), F.lit("all"))


@query(_stump_sql("labelled", SHORT_SQL))
def train_by_regime_stumps(spark, sf):
    p = _written(fx.labelled_panel(spark, sf), "vix")
    fitted = ops.train_by_regime(p, STUMP_FEATURES, TARGET, STUMPS)
    label = expr.regime_by_level(F.col("vix"), labels=expr.SHORT_LABELS)
    return _predicted(ops.predict_by_regime(p, fitted, STUMP_FEATURES), label)


LIVE_SQL = f"""
SELECT d AS window_start, n, round(corr, 6) + 0.0 AS corr, coalesce(corr < 0, FALSE) AS regime_change
FROM ({spearman_sql("(SELECT date_trunc('day', ts) AS d, value, user_id FROM events)", "d", "value", "user_id")})
WHERE TRUE"""


def _live(df):
    # plain timestamp text keeps both engines' types equal
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"),
        "n",
        r("corr").alias("corr"),
        "regime_change",
    )


LIVE_OUT_SQL = LIVE_SQL.replace("SELECT d AS window_start", "SELECT strftime(d, '%Y-%m-%d') AS window_start")


@query(LIVE_OUT_SQL)
def regime_change_monitor(spark, sf):
    return _live(
        monitor.regime_change_batch(fx.live(spark, sf), "ts", "prediction", "target")
    )


@query(
    LIVE_OUT_SQL
    + " AND d < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events)"
)
def regime_change_stream(spark, sf):
    """The same as a stream: windows are reported once the watermark has closed them."""
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("prediction"),
        F.col("user_id").alias("target"),
    )
    path = shared_dir(spark, "live")
    monitor.start_monitor(stream, path).awaitTermination()
    return _live(monitor.read_results(spark, path))
