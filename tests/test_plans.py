"""Properties of physical plans that matter on large tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.functions.ranking import counted, distribution
from panelspark.operators.splits import sample_per_era
from panelspark.plans import fixtures as fx


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "adaptive_target", "adaptive_target_ensemble", "adaptive_target_per_era", "join_indicator",
        "regime_correlations", "evaluate_predictions", "score_by_era", "walk_forward",
        "cross_validate", "impute_median", "tversky", "motif_mine", "select_ratios",
    ],
)
def test_no_pairs_of_rows(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark, sf):
    plan = plan_of(entry.queries()["regime_distribution"](spark, sf))
    reads = [x for x in plan.split("ReadSchema: ")[1:]]
    assert reads and not any("l_tax" in x.split(">")[0] or "l_comment" in x.split(">")[0] for x in reads)


def test_era_filter_reaches_the_scan(spark, sf):
    plan = plan_of(entry.queries()["scan_eras"](spark, sf))
    assert "PushedFilters: [In(o_orderpriority" in plan


def test_samples_do_not_shuffle_rows_before_they_are_cut(spark, sf):
    """Rows are joined with the broadcast cuts in the scan's stage."""
    plan = plan_of(sample_per_era(fx.panel(spark, sf).select("era", *fx.KEYS), 100, keys=fx.KEYS))
    assert "BroadcastHashJoin" in plan and plan.count("Window") <= 2


def test_ranks_split_a_group_over_ranges(spark, sf):
    """Also from a frame whose size the optimizer does not know; no array travels with rows."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("g", F.lit("one")).checkpoint()
    values = counted(li, ["g"], "l_extendedprice")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = distribution(values, ["g"], "l_extendedprice")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = plan_of(out)
    assert "array" not in plan
    placed = [x for x in out.inputFiles() if "values-" in x]
    assert len(placed) >= 4
    rows, seen, n = out.orderBy("l_extendedprice").collect(), 0, li.count()
    for r in rows:
        assert r["below"] == seen and r["total"] == n
        seen += r["weight"]
    assert seen == n
