"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import windows
from plumbline.plans import aggregates, delivery, relational, texts, timeseries

DATA = "/root/testdata/sf0.001"
#: Joins with a frame of one row, or grids of dimension values: their other side can't grow.
ONE_ROW = {"term_demand", "prevalence_difference", "did_randomisation", "anchor_rescale", "profile_grid"}
QUICK = [(n, m) for m in (aggregates, relational, texts, timeseries) for n in m.QUERIES]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,module", QUICK, ids=[q[0] for q in QUICK])
def test_no_pairs_of_everything(spark, name, module):
    p = plan(module.QUERIES[name](spark, DATA))
    if name not in ONE_ROW:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p, "row-at-a-time Python"


def test_scans_read_only_what_is_needed(spark):
    p = plan(delivery._filled(spark, DATA).deliveries())
    assert re.search(r"ReadSchema: struct<k:string,n:bigint>", p)
    p = plan(relational.QUERIES["window_bounds"](spark, DATA))
    assert "description" not in p and "created" in p


def test_filters_reach_the_scan(spark):
    p = plan(relational.QUERIES["multi_filter"](spark, DATA))
    assert "PushedFilters: [In(o_orderpriority" in p.replace("  ", " ") or "In(o_orderpriority" in p


def test_group_limits_are_partial(spark):
    assert "WindowGroupLimit" in plan(aggregates.QUERIES["topk_per_group"](spark, DATA))


def test_prefix_sums_keep_a_column_in_many_tasks(spark):
    df = spark.range(10_000).withColumn("c", F.lit(1))
    out = windows.prefix_sums(df, [], "id", ["c"])
    assert out.filter("run_c <> id + 1 or all_c <> 10000").count() == 0
