"""All registered queries."""

from __future__ import annotations

from panelspark.plans import (  # noqa: F401  (importing registers)
    discovery_queries,
    feature_queries,
    metric_queries,
    model_queries,
    regime_queries,
    run_queries,
    source_queries,
    split_queries,
    stability_queries,
    target_queries,
)
from panelspark.plans.registry import ORACLES, QUERIES
from panelspark.session import SETTINGS

# Results are compared in UTC; the other settings stay the session's own.
REQUIRED = {"spark.sql.session.timeZone": SETTINGS["spark.sql.session.timeZone"]}


def _prepared(fn):
    def run(spark, sf_dir):
        for key, value in REQUIRED.items():
            spark.conf.set(key, value)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def prepared(found: dict) -> dict:
    return {name: _prepared(fn) for name, fn in found.items()}


def queries() -> dict:
    return prepared(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
