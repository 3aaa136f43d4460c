"""Registry of named queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def r(c, digits: int = 6) -> Column:
    """Rounded for comparison across engines; adding zero removes a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def draw_sql(keys: list[str], seed: int = 42) -> str:
    """The random draw of a row as SQL text, for integer keys."""
    texts = ", ".join(f"cast({k} AS varchar)" for k in keys)
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {texts})), 1, 15) AS bigint)"


PANEL_SQL = """
SELECT lpad(cast(dense_rank() OVER (ORDER BY date_trunc('{unit}', l_shipdate)) AS varchar), 4, '0') AS era,
       cast(dense_rank() OVER (ORDER BY date_trunc('{unit}', l_shipdate)) AS int) AS era_idx,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_quantity AS feature_quantity, l_extendedprice AS feature_price,
       l_discount AS feature_discount, l_tax AS feature_tax,
       CASE WHEN month(l_shipdate) % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END AS feature_flip,
       l_extendedprice * (1 - l_discount) AS target_net,
       l_extendedprice * (1 + l_tax) AS target_gross,
       o_totalprice AS target_order
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS = {
    "panel": PANEL_SQL.format(unit="month"),
    "day_panel": PANEL_SQL.format(unit="day"),
    "gappy": """
SELECT * REPLACE (CASE WHEN feature_tax > 0 THEN target_gross END AS target_gross,
                  CASE WHEN feature_discount > 0 THEN feature_quantity END AS feature_quantity)
FROM panel""",
    "indicator": """
SELECT lpad(cast(row_number() OVER (ORDER BY mon) AS varchar), 4, '0') AS era,
       20 + 7 * (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS vix
FROM (SELECT date_trunc('month', o_orderdate) AS mon, avg(o_totalprice) AS a FROM orders GROUP BY 1)""",
    "era_weights": """
SELECT e.era, e.era_idx, j.target_idx, (1 + (e.era_idx + j.target_idx) % 3) / cast(6 AS double) AS w
FROM (SELECT DISTINCT era, era_idx FROM panel) e CROSS JOIN (VALUES (0), (1), (2)) AS j(target_idx)
WHERE e.era_idx % 10 <> 0""",
    "wide_weights": """
SELECT era, max(CASE WHEN target_idx = 0 THEN w END) AS w0, max(CASE WHEN target_idx = 1 THEN w END) AS w1,
       max(CASE WHEN target_idx = 2 THEN w END) AS w2
FROM era_weights GROUP BY era""",
    "panel_binned": """
SELECT era, era_idx, cast(floor(feature_quantity / 10) AS double) AS feature_0,
       round(feature_discount * 100) AS feature_1, round(feature_tax * 100) AS feature_2,
       cast(l_linenumber AS double) AS feature_3, target_net / 100000.0 AS target
FROM panel""",
    "prices": """
SELECT o_orderpriority AS ticker, cast(o_orderdate AS date) AS dt, min(o_totalprice) AS low,
       max(o_totalprice) AS high, avg(o_totalprice) AS close, count(*) AS volume
FROM orders GROUP BY 1, 2""",
    "predictions": """
SELECT era, era_idx, target_net AS target, feature_price + 100 * feature_quantity AS prediction FROM panel""",
    "regimes": """
SELECT era, vix, CASE WHEN vix IS NULL THEN 'unknown' WHEN vix > 25 THEN 'high_vol_crisis'
       WHEN vix < 15 THEN 'low_vol_grind' ELSE 'transition' END AS regime FROM indicator""",
    "labelled": """
SELECT p.*, i.vix, coalesce(i.regime, 'unknown') AS regime FROM panel p LEFT JOIN regimes i USING (era)""",
    "vectors": """
SELECT vec_id, lpad(cast(vec_id // 100 AS varchar), 4, '0') AS era,
       cast(embedding AS double[]) AS features, label FROM embeddings""",
    # long form of the labelled panel
    "cells": """
SELECT regime, 'feature_quantity' AS feature, 0 AS pos, feature_quantity AS value, target_net FROM labelled
UNION ALL SELECT regime, 'feature_price', 1, feature_price, target_net FROM labelled
UNION ALL SELECT regime, 'feature_discount', 2, feature_discount, target_net FROM labelled
UNION ALL SELECT regime, 'feature_tax', 3, feature_tax, target_net FROM labelled
UNION ALL SELECT regime, 'feature_flip', 4, feature_flip, target_net FROM labelled""",
    "ranked": """
SELECT *, rank() OVER (PARTITION BY regime, feature ORDER BY value)
          + (count(*) OVER (PARTITION BY regime, feature, value) - 1) / 2.0 AS rx,
       rank() OVER (PARTITION BY regime, feature ORDER BY target_net)
          + (count(*) OVER (PARTITION BY regime, feature, target_net) - 1) / 2.0 AS ry
FROM cells""",
    "regime_corrs": """
SELECT regime, feature, pos, count(*) AS n,
       covar_pop(cast(rx AS double), cast(ry AS double))
       / nullif(stddev_pop(cast(rx AS double)) * stddev_pop(cast(ry AS double)), 0) AS corr
FROM ranked GROUP BY regime, feature, pos""",
}
NEEDS = {
    "gappy": ["panel"], "era_weights": ["panel"], "wide_weights": ["era_weights"],
    "panel_binned": ["panel"], "predictions": ["panel"], "regimes": ["indicator"],
    "labelled": ["panel", "regimes"], "cells": ["labelled"], "ranked": ["cells"],
    "regime_corrs": ["ranked"],
}


def sql(body: str, *views: str) -> str:
    """A query over named views, with everything they need in front."""
    order: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def spearman_sql(source: str, groups: str, x: str, y: str) -> str:
    """Average-rank correlation per group as SQL text (NULL when a side is constant)."""
    part = f"PARTITION BY {groups}" if groups else ""
    within = f"PARTITION BY {groups}, " if groups else "PARTITION BY "
    lead = f"{groups}, " if groups else ""
    tail = f"GROUP BY {groups}" if groups else ""
    return f"""
SELECT {lead}count(*) AS n,
       covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS corr
FROM (SELECT {lead}cast(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({within}{x}) - 1) / 2.0 AS double) AS rx,
             cast(rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({within}{y}) - 1) / 2.0 AS double) AS ry
      FROM {source}) {tail}"""
