"""Queries for the search of target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import boosting
from panelspark.operators import discovery as ops
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import draw_sql, query, r, sql
from panelspark.sources.panel import era_index

BASIS = ["feature_price", "feature_flip", "feature_quantity"]

# Enumerated blends of three targets, as SQL rows.
COMBOS3_SQL = "(VALUES " + ", ".join(
    f"({i}, {float(w[0])!r}::double, {float(w[1])!r}::double, {float(w[2])!r}::double)"
    for i, w in enumerate(ops.blends(3))
) + ") AS c(combo_id, w0, w1, w2)"


@query(
    """
WITH RECURSIVE n AS (SELECT count(DISTINCT label) AS n FROM embeddings),
t AS (SELECT cast(i AS int) AS i FROM n, unnest(range(n)) AS u(i)),
combos AS (
  SELECT 0 AS kind, i AS a, -1 AS b, -1 AS c FROM t
  UNION ALL SELECT 1, -1, -1, -1
  UNION ALL SELECT 2, x.i, y.i, -1 FROM t x JOIN t y ON x.i < y.i
  UNION ALL SELECT 3, x.i, y.i, z.i FROM t x JOIN t y ON x.i < y.i JOIN t z ON y.i < z.i),
numbered AS (SELECT *, cast(row_number() OVER (ORDER BY kind, a, b, c) - 1 AS int) AS combo_id FROM combos)
SELECT combo_id, t.i AS target_idx,
       round(cast(CASE kind WHEN 0 THEN CASE WHEN t.i = a THEN 1.0 ELSE 0 END
                       WHEN 1 THEN 1.0 / n
                       WHEN 2 THEN CASE t.i WHEN a THEN 0.6 WHEN b THEN 0.4 ELSE 0 END
                       ELSE CASE t.i WHEN a THEN 0.4 WHEN b THEN 0.35 WHEN c THEN 0.25 ELSE 0 END END AS double), 6) + 0.0 AS w
FROM numbered CROSS JOIN t CROSS JOIN n"""
)
def target_combinations(spark, sf):
    """Blends of as many targets as the vectors have labels."""
    n = fx.table(spark, sf, "embeddings").select("label").distinct().count()
    out = ops.target_combinations(spark, n)
    return out.select("combo_id", F.posexplode("weights").alias("target_idx", "w")).withColumn(
        "w", r("w")
    )


# With one feature a ridge fit is a quotient, so SQL can follow the fits over all rows.
ONE_FEATURE = "feature_flip"
SPLIT_SQL = f"""
halves AS (SELECT *, k <= floor(0.7::double * n) AS is_train FROM (
  SELECT era, era_idx, {ONE_FEATURE} AS x, target_net AS y0, target_gross AS y1, target_order AS y2,
         count(*) OVER (PARTITION BY era) AS n,
         row_number() OVER (PARTITION BY era ORDER BY {draw_sql(fx.KEYS)}, {", ".join(fx.KEYS)}, {ONE_FEATURE}, target_net, target_gross, target_order) AS k
  FROM panel) WHERE n >= 100),
fits AS (SELECT era, era_idx, {", ".join(f"count(*) * covar_pop(x, y{i}) / (count(*) * var_pop(x) + 1) AS b{i}" for i in range(3))}
         FROM halves WHERE is_train GROUP BY era, era_idx)"""


@query(
    sql(
        f"""
WITH {SPLIT_SQL}
SELECT era, count(*) AS n_test, round(b0 * b0 * var_pop(x) / var_pop(y0), 6) + 0.0 AS pred_share,
       round(b0 * covar_pop(x, y0) / var_pop(y0), 6) + 0.0 AS slope,
       round(b0 * covar_pop(x, y2) / var_pop(y2), 6) + 0.0 AS cross_slope, 1.0::double AS min_eigenvalue
FROM halves JOIN fits USING (era) WHERE NOT is_train GROUP BY era, b0""",
        "panel",
    )
)
def era_ridge_moments(spark, sf):
    """Held-out moments of ridge fits with one feature, over all rows."""
    out = ops.era_ridge_moments(fx.panel(spark, sf), [ONE_FEATURE], fx.TARGETS, keys=fx.KEYS)
    pp, yy, py = (F.col(c) for c in ("c_pp", "c_yy", "c_py"))
    return out.select(
        "era",
        "n_test",
        r(pp[0] / yy[0]).alias("pred_share"),
        r(py[0] / yy[0]).alias("slope"),
        r(py[2] / yy[8]).alias("cross_slope"),
        r("min_eigenvalue").alias("min_eigenvalue"),
    )


@query()
def era_ridge_moments_wide(spark, sf):
    """All 64 vector positions and ten targets."""
    targets = [f"target_{k}" for k in range(fx.LABELS)]
    v = fx.vector_panel(spark, sf, 64)
    out = ops.era_ridge_moments(v, [f"feature_{i}" for i in range(64)], targets)
    return out.select(
        "era",
        "n_test",
        *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("c_pp", "c_yy", "c_py")],
        r("min_eigenvalue").alias("min_eigenvalue"),
    )


SCORES_SQL = f"""
SELECT era, era_idx, combo_id, covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0) AS corr
FROM (SELECT era, era_idx, combo_id, feature_price * w0 + feature_flip * w1 + feature_quantity * w2 AS p,
             target_net * w0 + target_gross * w1 + target_order * w2 AS y FROM panel CROSS JOIN {COMBOS3_SQL})
GROUP BY era, era_idx, combo_id"""


def _scores(spark, sf):
    moments = ops.basis_moments(fx.panel(spark, sf), BASIS, fx.TARGETS)
    return ops.score_by_era(moments, ops.blends(3))


@query(
    sql(
        f"SELECT era, combo_id, round(corr, 6) + 0.0 AS corr FROM ({SCORES_SQL})", "panel"
    )
)
def score_by_era(spark, sf):
    return _scores(spark, sf).select("era", "combo_id", r("corr").alias("corr"))


def history_sql(scores: str, keys: str) -> str:
    """Blend statistics over groups of era correlations."""
    return f"""
SELECT {keys}, CASE WHEN n < 2 THEN 0 ELSE abs(mean) END AS mean_score, CASE WHEN n < 2 THEN 0 ELSE std END AS std_score,
       CASE WHEN n < 2 THEN 0 ELSE positive / cast(n AS double) END AS sign_consistency,
       CASE WHEN n < 2 OR uniq <= 1 OR width < 1e-12 OR std < 1e-12 OR mad < 1e-12 THEN 0 ELSE mean / (std + 1e-9) END AS sharpe
FROM (SELECT {keys}, count(corr) AS n, avg(corr) AS mean, coalesce(stddev_samp(corr), 0) AS std, count(*) FILTER (corr > 0) AS positive,
             count(DISTINCT round(corr, 12)) AS uniq, max(corr) - min(corr) AS width, median(abs(corr - middle)) AS mad
      FROM (SELECT *, median(corr) OVER (PARTITION BY {keys}) AS middle FROM ({scores}) WHERE corr IS NOT NULL) GROUP BY {keys})"""


STAT_COLUMNS = ["mean_score", "std_score", "sign_consistency", "sharpe"]


@query(
    sql(
        "SELECT combo_id, "
        + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in STAT_COLUMNS)
        + f" FROM ({history_sql(SCORES_SQL, 'combo_id')})",
        "panel",
    )
)
def score_combinations(spark, sf):
    out = ops.score_combinations(_scores(spark, sf))
    return out.select("combo_id", *[r(c).alias(c) for c in STAT_COLUMNS])


@query(
    sql(
        f"SELECT era, combo_id, round(corr, 6) + 0.0 AS sharpe FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY era ORDER BY corr DESC NULLS LAST, combo_id) AS k FROM ({SCORES_SQL})) WHERE k = 1",
        "panel",
    )
)
def best_combination(spark, sf):
    scores = _scores(spark, sf).withColumnRenamed("corr", "sharpe")
    best = ops.best_combination(scores, ["era"])
    return best.select("era", "combo_id", r("sharpe").alias("sharpe"))


HISTORY_SQL = f"""
scores AS ({SCORES_SQL}),
sizes AS (SELECT era, era_idx, count(*) AS n_rows FROM panel GROUP BY era, era_idx),
past AS (SELECT e.era, e.era_idx, s.combo_id, s.corr FROM sizes e JOIN scores s ON s.era_idx BETWEEN e.era_idx - 50 AND e.era_idx - 1),
hist AS (SELECT e.era, sum(h.n_rows) AS n_hist FROM sizes e JOIN sizes h ON h.era_idx BETWEEN e.era_idx - 50 AND e.era_idx - 1 GROUP BY e.era),
stats AS ({history_sql("SELECT era, combo_id, corr FROM past", "era, combo_id")}),
best AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY sharpe DESC, combo_id) AS k FROM stats)"""


@query(
    sql(
        f"""
WITH {HISTORY_SQL},
warm AS (SELECT least(20, greatest(0, max(era_idx) - 1)) AS warmup FROM sizes)
SELECT z.era, CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN b.combo_id END AS combo_id,
       round(CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN b.sharpe END, 2) + 0.0 AS sharpe,
       round(CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN c.w0 ELSE 1/3.0 END, 6) + 0.0 AS w0,
       round(CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN c.w1 ELSE 1/3.0 END, 6) + 0.0 AS w1,
       round(CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN c.w2 ELSE 1/3.0 END, 6) + 0.0 AS w2
FROM sizes z CROSS JOIN warm LEFT JOIN hist h ON h.era = z.era LEFT JOIN (FROM best WHERE k = 1) b ON b.era = z.era
LEFT JOIN {COMBOS3_SQL} ON c.combo_id = b.combo_id""",
        "panel",
    )
)
def walk_forward(spark, sf):
    p = fx.panel(spark, sf)
    out = ops.walk_forward(era_index(p), _scores(spark, sf), ops.blends(3), 50, 20)
    w = F.col("weights")
    return out.select(
        "era", "combo_id", r("sharpe", 2).alias("sharpe"), *[r(w[i]).alias(f"w{i}") for i in range(3)]
    )


WALK_FEATURES = ["feature_price", "feature_discount", "feature_tax", "feature_quantity"]


RIDGE_SCORES_SQL = f"""
SELECT era, h.era_idx, combo_id,
       sign(b0 * w0 + b1 * w1 + b2 * w2) * covar_pop(x, y0 * w0 + y1 * w1 + y2 * w2)
         / nullif(stddev_pop(x) * stddev_pop(y0 * w0 + y1 * w1 + y2 * w2), 0) AS corr
FROM halves h JOIN fits USING (era) CROSS JOIN {COMBOS3_SQL} WHERE NOT is_train
GROUP BY era, h.era_idx, combo_id, w0, w1, w2, b0, b1, b2"""


@query(
    sql(
        f"""
WITH {SPLIT_SQL}, {HISTORY_SQL.replace(SCORES_SQL, RIDGE_SCORES_SQL, 1)},
warm AS (SELECT least(20, greatest(0, max(era_idx) - 1)) AS warmup FROM sizes)
SELECT z.era, CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN b.combo_id END AS combo_id,
       round(CASE WHEN era_idx > warmup AND n_hist >= 1000 THEN b.sharpe END, 4) + 0.0 AS sharpe
FROM sizes z CROSS JOIN warm LEFT JOIN hist h ON h.era = z.era LEFT JOIN (FROM best WHERE k = 1) b ON b.era = z.era""",
        "panel",
    )
)
def walk_forward_weights(spark, sf):
    """From rows to weights with the per-era ridge fits, one feature."""
    out = ops.walk_forward_weights(fx.panel(spark, sf), [ONE_FEATURE], fx.TARGETS, keys=fx.KEYS)
    return out.select("era", "combo_id", r("sharpe", 4).alias("sharpe"))


@query()
def walk_forward_weights_wide(spark, sf):
    """The same with several features."""
    out = ops.walk_forward_weights(fx.panel(spark, sf), WALK_FEATURES, fx.TARGETS)
    return out.select("era", "combo_id", r("sharpe").alias("sharpe"), F.array_join(
        F.transform("weights", lambda w: F.round(w, 6).cast("string")), "|").alias("weights"))


def _top_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT era, '{f}' AS feature, {i + 1} AS pos, {f} AS x, y FROM blended"
        for i, f in enumerate(fx.FEATURES)
    )
    return sql(
        f"""
WITH blended AS (SELECT *, target_net * 0.6 + target_order * 0.4 AS y FROM panel), cells2 AS ({cells}),
corrs AS (SELECT era, feature, pos, coalesce(abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 0) AS abs_corr
          FROM cells2 GROUP BY era, feature, pos)
SELECT era, feature, rank, round(abs_corr, 6) + 0.0 AS abs_corr
FROM (SELECT *, cast(row_number() OVER (PARTITION BY era ORDER BY abs_corr DESC, pos) AS int) AS rank FROM corrs) WHERE rank <= 3""",
        "panel",
    )


@query(_top_sql())
def top_features_per_era(spark, sf):
    p = fx.panel(spark, sf).withColumn("y", F.col("target_net") * 0.6 + F.col("target_order") * 0.4)
    out = ops.top_features_per_era(p, fx.FEATURES, "y", 3)
    return out.select("era", "feature", "rank", r("abs_corr").alias("abs_corr"))


@query(
    sql(
        """
WITH cells2 AS (SELECT era, 'a' AS f, CASE WHEN era_idx % 9 = 0 THEN 1.0 ELSE target_net END AS v FROM panel
                UNION ALL SELECT era, 'b', CASE WHEN era_idx % 3 = 0 THEN 2.0 ELSE target_order END FROM panel),
mads AS (SELECT era, f, median(abs(v - m)) AS mad FROM (SELECT *, median(v) OVER (PARTITION BY era, f) AS m FROM cells2) GROUP BY era, f)
SELECT era, round(max(mad), 6) + 0.0 AS max_mad FROM mads GROUP BY era HAVING max(mad) < 1e-12""",
        "panel",
    )
)
def degenerate_eras(spark, sf):
    """Eras in which both targets were made constant."""
    p = fx.panel(spark, sf).select(
        "era",
        F.when(F.col("era_idx") % 9 == 0, 1.0).otherwise(F.col("target_net")).alias("target_a"),
        F.when(F.col("era_idx") % 3 == 0, 2.0).otherwise(F.col("target_order")).alias("target_b"),
    )
    return ops.degenerate_eras(p, ["target_a", "target_b"]).withColumn("max_mad", r("max_mad"))


@query()
def condition_number(spark, sf):
    out = ops.condition_number(fx.panel(spark, sf), WALK_FEATURES, ["era"])
    return out.select("era", r("condition", 4).alias("condition"), r("min_eigenvalue", 6).alias("min_eigenvalue"))


@query(
    sql(
        """
SELECT era, round((1 + abs(c)) / (1 - abs(c)), 6) + 0.0 AS condition, round(1 - abs(c), 6) + 0.0 AS min_eigenvalue
FROM (SELECT era, covar_pop(feature_price, target_order) / (stddev_pop(feature_price) * stddev_pop(target_order)) AS c
      FROM panel GROUP BY era)""",
        "panel",
    )
)
def condition_number_pair(spark, sf):
    """Two columns have the eigenvalues 1 - |corr| and 1 + |corr|."""
    out = ops.condition_number(fx.panel(spark, sf), ["feature_price", "target_order"], ["era"])
    return out.select(
        "era", r("condition").alias("condition"), r("min_eigenvalue").alias("min_eigenvalue")
    )


N_VECTOR_COMBOS = len(ops.blends(fx.LABELS))


def _spread_sql() -> str:
    """Variance of every blend of the label indicators, best fifth (at least 15) first."""
    rows = ", ".join(
        f"({i}, [{', '.join(repr(float(x)) for x in w)}]::double[])"
        for i, w in enumerate(ops.blends(fx.LABELS))
    )
    keep = max(ops.KEEP_AT_LEAST, N_VECTOR_COMBOS // ops.KEEP_SHARE)
    return f"""
WITH combos(combo_id, w) AS (VALUES {rows}),
scores AS (SELECT combo_id, var_pop(w[label + 1]) AS score FROM embeddings CROSS JOIN combos GROUP BY combo_id)
SELECT combo_id, round(score, 6) + 0.0 AS score FROM scores ORDER BY round(score, 9) DESC, combo_id LIMIT {keep}"""


@query(_spread_sql())
def keep_top(spark, sf):
    """Pre-screen of all blends of the labels, scored by the variance of the blend."""
    v = fx.vectors(spark, sf)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in ops.blends(fx.LABELS)])
    cells = v.select(
        F.posexplode(F.transform(table, lambda w: F.element_at(w, F.col("label") + 1))).alias(
            "combo_id", "x"
        )
    )
    scores = cells.groupBy("combo_id").agg(F.round(F.var_pop("x"), 9).alias("score"))
    return ops.keep_top(scores, N_VECTOR_COMBOS).select("combo_id", r("score").alias("score"))


@query(
    sql(
        f"""
WITH {SPLIT_SQL}
SELECT combo_id, round(avg(abs(corr)), 6) + 0.0 AS score FROM ({RIDGE_SCORES_SQL}) GROUP BY combo_id""",
        "panel",
    )
)
def ridge_prescreen(spark, sf):
    """With one feature the held-out correlation is the feature's own."""
    out = ops.ridge_prescreen(fx.panel(spark, sf), [ONE_FEATURE], fx.TARGETS, ops.blends(3), keys=fx.KEYS)
    return out.withColumn("score", r("score"))


@query()
def ridge_prescreen_wide(spark, sf):
    out = ops.ridge_prescreen(fx.panel(spark, sf), WALK_FEATURES, fx.TARGETS, ops.blends(3))
    return out.withColumn("score", r("score"))


# More than ten blends, so that the pre-screen works: five targets.
MANY_TARGETS = ["target_net", "target_gross", "target_order", "feature_flip", "feature_quantity"]
COARSE = ["feature_discount", "feature_tax"]
MANY_COMBOS = ops.blends(len(MANY_TARGETS))


def _screened_sql(p: int, refined: bool) -> str:
    """Walk-forward over ``p`` coarse features with the pre-screen, and with stumps for the three best."""
    combos = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in w)}]::double[])" for i, w in enumerate(MANY_COMBOS))
    moments = ["count(*) AS n", *[f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in range(p) for j in range(i, p)],
               *[f"covar_pop(x{i}, y) AS r{i}" for i in range(p)]]
    if p == 1:
        plain = ["n * r0 / (n * c00 + 1)"]
        scaled = ["n * r0 / c00 / (n + 1)"]
    else:
        det = "((n * c00 + 1) * (n * c11 + 1) - n * c01 * n * c01)"
        plain = [f"((n * c11 + 1) * n * r0 - n * c01 * n * r1) / {det}", f"((n * c00 + 1) * n * r1 - n * c01 * n * r0) / {det}"]
        d0, d1, g = "sqrt(c00)", "sqrt(c11)", "(n * c01 / sqrt(c00 * c11))"
        det = f"((n + 1) * (n + 1) - {g} * {g})"
        scaled = [f"((n + 1) * n * r0 / {d0} - {g} * n * r1 / {d1}) / {det} / {d0}",
                  f"((n + 1) * n * r1 / {d1} - {g} * n * r0 / {d0}) / {det} / {d1}"]
    fits = ", ".join(f"{e} AS {t}{i}" for t, es in (("b", plain), ("s", scaled)) for i, e in enumerate(es))

    def corr(t):
        f = " + ".join(f"{t}{i} * x{i}" for i in range(p))
        return f"covar_pop({f}, y) / nullif(stddev_pop({f}) * stddev_pop(y), 0)"

    xs = ", ".join(f"x{i}" for i in range(p))
    body = f"""
WITH combos(combo_id, w) AS (VALUES {combos}),
halves AS (SELECT *, k <= floor(0.7::double * n) AS is_train FROM (
  SELECT era, era_idx, {", ".join(f"{c} AS x{i}" for i, c in enumerate(COARSE[:p]))}, [{", ".join(MANY_TARGETS)}]::double[] AS ys,
         count(*) OVER (PARTITION BY era) AS n,
         row_number() OVER (PARTITION BY era ORDER BY {draw_sql(fx.KEYS)}, {", ".join(fx.KEYS)}) AS k
  FROM panel) WHERE n >= 100),
blended AS MATERIALIZED (SELECT era, era_idx, is_train, {xs}, combo_id, list_dot_product(ys, w) AS y FROM halves CROSS JOIN combos),
fits AS (SELECT era, combo_id, {fits} FROM (
  SELECT era, combo_id, {", ".join(moments)} FROM blended WHERE is_train GROUP BY era, combo_id)),
scored AS (SELECT era, any_value(era_idx) AS era_idx, combo_id, {corr("b")} AS corr, abs({corr("s")}) AS score
         FROM blended JOIN fits USING (era, combo_id) WHERE NOT is_train GROUP BY era, combo_id),
sizes AS (SELECT era, era_idx, count(*) AS n_rows FROM panel GROUP BY era, era_idx),
hist AS (SELECT e.era, sum(h.n_rows) AS n_hist, count(*) AS n_eras FROM sizes e JOIN sizes h
         ON h.era_idx BETWEEN e.era_idx - 50 AND e.era_idx - 1 GROUP BY e.era),
past AS (SELECT e.era, s.combo_id, s.corr, s.score FROM sizes e JOIN scored s ON s.era_idx BETWEEN e.era_idx - 50 AND e.era_idx - 1),
kept AS (SELECT era, combo_id FROM (
  SELECT e.era, c.combo_id, row_number() OVER (PARTITION BY e.era ORDER BY CASE WHEN n_eras >= 3 THEN coalesce(score, 0) ELSE 0 END DESC, c.combo_id) AS k
  FROM sizes e CROSS JOIN combos c LEFT JOIN hist USING (era)
  LEFT JOIN (SELECT era, combo_id, avg(score) AS score FROM past GROUP BY era, combo_id) m ON m.era = e.era AND m.combo_id = c.combo_id)
  WHERE k <= 15),
stats AS ({history_sql("SELECT era, combo_id, corr FROM past JOIN kept USING (era, combo_id)", "era, combo_id")}),
warm AS (SELECT least(20, greatest(0, max(era_idx) - 1)) AS warmup FROM sizes),
open AS (SELECT era FROM sizes CROSS JOIN warm JOIN hist USING (era) WHERE era_idx > warmup AND n_hist >= 1000),
ranked AS (SELECT era, combo_id, sharpe, row_number() OVER (PARTITION BY era ORDER BY sharpe DESC, combo_id) AS k
           FROM stats JOIN open USING (era)),
"""
    if refined:
        cells = " UNION ALL ".join(f"SELECT era, combo_id, {i} AS f, x{i} AS v, y - middle AS d FROM centred" for i in range(p))
        side = " ".join(f"WHEN {i} THEN x{i} <= v" for i in range(p))
        body += f"""
centred AS (SELECT *, avg(y) OVER (PARTITION BY era, combo_id) AS middle FROM blended WHERE is_train),
cells AS (SELECT era, combo_id, f, v, sum(d) AS s, count(*) AS n FROM ({cells}) GROUP BY era, combo_id, f, v),
ends AS (SELECT *, sum(s) OVER upto AS sl, sum(n) OVER upto AS nl, sum(s) OVER whole AS st, sum(n) OVER whole AS nt FROM cells
         WINDOW upto AS (PARTITION BY era, combo_id, f ORDER BY v), whole AS (PARTITION BY era, combo_id, f)),
stumps AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY era, combo_id ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt DESC, f, v) AS place
  FROM ends WHERE nl >= 20 AND nt - nl >= 20) WHERE place = 1),
grown AS (
  SELECT era, any_value(era_idx) AS era_idx, combo_id, covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0) AS corr
  FROM (SELECT era, era_idx, combo_id, y, 0.2 * CASE WHEN CASE f {side} END THEN sl / nl ELSE (st - sl) / (nt - nl) END AS p
        FROM blended JOIN stumps USING (era, combo_id) WHERE NOT is_train) GROUP BY era, combo_id),
deeper AS (SELECT e.era, r.combo_id, g.corr FROM ranked r JOIN sizes e USING (era) JOIN grown g
           ON g.combo_id = r.combo_id AND g.era_idx BETWEEN e.era_idx - 50 AND e.era_idx - 1 WHERE r.k <= 3),
again AS ({history_sql("SELECT era, combo_id, corr FROM deeper", "era, combo_id")}),
final AS (SELECT era, combo_id, k, CASE WHEN k <= 3 THEN coalesce(a.sharpe, 0) ELSE r.sharpe END AS sharpe
          FROM ranked r LEFT JOIN again a USING (era, combo_id)),
"""
    else:
        body += "final AS (FROM ranked),"
    return sql(body + """
best AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY sharpe DESC, k) AS place FROM final)
SELECT z.era, b.combo_id, round(b.sharpe, 4) + 0.0 AS sharpe FROM sizes z LEFT JOIN (FROM best WHERE place = 1) b USING (era)""", "panel")


def _screened(spark, sf, p, **options):
    out = ops.walk_forward_weights(fx.panel(spark, sf), COARSE[:p], MANY_TARGETS, keys=fx.KEYS, prescreen=True, **options)
    return out.select("era", "combo_id", r("sharpe", 4).alias("sharpe"))


@query(_screened_sql(1, False))
def walk_forward_screened(spark, sf):
    """Of 26 blends the 15 with the best pre-screen over earlier eras compete, one feature."""
    return _screened(spark, sf, 1)


@query(_screened_sql(2, False))
def walk_forward_screened_pair(spark, sf):
    """The same with two features."""
    return _screened(spark, sf, 2)


@query(_screened_sql(2, True))
def walk_forward_hybrid(spark, sf):
    """Pre-screen, ridge scores, and the three best of each era scored again with one stump per era."""
    stump = boosting.Settings(rounds=1, depth=1, step=0.2, row_share=1.0, feature_share=1.0)
    return _screened(spark, sf, 2, mode="hybrid", refine=stump)


@query()
def refine_top_k(spark, sf):
    """The three best blends, scored again by twenty rounds of trees in every era."""
    scores = ops.score_combinations(_scores(spark, sf))
    out = ops.refine_top_k(fx.panel(spark, sf), WALK_FEATURES, fx.TARGETS, scores, keys=fx.KEYS)
    return out.select("combo_id", *[r(c).alias(c) for c in STAT_COLUMNS])
