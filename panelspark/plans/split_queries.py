"""Queries for era splits and repeatable samples."""

from __future__ import annotations

from panelspark.operators import splits as ops
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import draw_sql, query, sql


def cv_sql(view: str, n_splits: int, gap: int) -> str:
    """Split rule as recursion over folds: each fold starts after the last validation era."""
    return f"""
RECURSIVE_EDGES AS (
  SELECT 0 AS fold, 1 AS t0, least(size, n) AS t1, least(size, n) + {gap} + 1 AS v0,
         least(least(size, n) + {gap} + size, n) AS v1, size, n
  FROM (SELECT count(*) AS n, greatest(1, (count(*) - {gap}) // {3 * n_splits - 1}) AS size FROM eras)
  UNION ALL
  SELECT fold + 1, v1 + 1, least(v1 + size, n), least(v1 + size, n) + {gap} + 1,
         least(least(v1 + size, n) + {gap} + size, n), size, n
  FROM RECURSIVE_EDGES WHERE fold + 1 < {n_splits} AND least(v1 + size, n) + {gap} + 1 <= n
)"""


def _splits_sql(view: str, n_splits: int, gap: int) -> str:
    text = sql(
        f"""
WITH eras AS (SELECT DISTINCT era, era_idx FROM {view}),
{cv_sql(view, n_splits, gap)}
SELECT fold, 'train' AS role, era, era_idx FROM RECURSIVE_EDGES JOIN eras ON era_idx BETWEEN t0 AND t1
UNION ALL
SELECT fold, 'val', era, era_idx FROM RECURSIVE_EDGES JOIN eras ON era_idx BETWEEN v0 AND v1""",
        view,
    )
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_splits_sql("panel", 5, 10))
def era_cv_splits(spark, sf):
    return ops.era_cv_splits(fx.panel(spark, sf), 5, 10)


@query(_splits_sql("day_panel", 5, 200))
def era_cv_splits_daily(spark, sf):
    """Large gap; the last fold is cut at the last era."""
    return ops.era_cv_splits(fx.day_panel(spark, sf), 5, 200)


@query(
    sql(
        """
SELECT max_train, min_test, min_test - max_train AS gap, min_test - max_train >= 10 AS passed
FROM (SELECT max(cast(era AS int)) FILTER (era_idx <= 40) AS max_train, min(cast(era AS int)) FILTER (era_idx >= 55) AS min_test FROM panel)""",
        "panel",
    )
)
def check_era_gap(spark, sf):
    p = fx.panel(spark, sf)
    return ops.check_era_gap(p.where("era_idx <= 40"), p.where("era_idx >= 55"), 10)


DRAWN_SQL = f"""
drawn AS (SELECT era, {", ".join(fx.KEYS)}, count(*) OVER (PARTITION BY era) AS n,
                 row_number() OVER (PARTITION BY era ORDER BY {draw_sql(fx.KEYS)}, {", ".join(fx.KEYS)}) AS k FROM panel)"""


@query(sql(f"WITH {DRAWN_SQL} SELECT era, {', '.join(fx.KEYS)} FROM drawn WHERE k <= 100", "panel"))
def sample_per_era(spark, sf):
    rows = fx.panel(spark, sf).select("era", *fx.KEYS)
    return ops.sample_per_era(rows, 100, keys=fx.KEYS)


@query(
    sql(
        f"WITH {DRAWN_SQL} SELECT era, {', '.join(fx.KEYS)}, k <= floor(0.7::double * n) AS is_train FROM drawn",
        "panel",
    )
)
def train_test_split(spark, sf):
    rows = fx.panel(spark, sf).select("era", *fx.KEYS)
    return ops.train_test_split(rows, 0.7, keys=fx.KEYS)
