"""Shape of the physical plans of every registered query."""

import re

import pytest

from plumbline import query
from plumbline.metrics import Predicate
from plumbline.queries import CASES
from plumbline.star import star


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_cross_join_udf_or_single_task_window(spark, sf, name):
    plan = plan_of(CASES[name].run(spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            # Only the last step of a global aggregate gathers, from partials.
            assert "partial_" in lines[i + 1] or "Aggregate" in lines[i + 1], line


def test_filters_and_columns_reach_the_scan(spark, sf):
    frame = query(
        star(spark, sf),
        ["valid_rows"],
        by=["region.r_name"],
        filters=[Predicate("orders.o_orderpriority", "1-URGENT")],
    )
    plan = plan_of(frame)
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "EqualTo(o_orderpriority,1-URGENT)" in orders
    read = re.search(r"ReadSchema: struct<([^>]*)>", orders).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"o_custkey", "o_orderstatus", "o_orderpriority"}


def test_fact_is_reduced_before_the_parent_join(spark, sf):
    frame = query(star(spark, sf), ["split_quantity"], by=["customer.c_mktsegment"])
    plan = plan_of(frame)
    scan = next(i for i, line in enumerate(plan.splitlines()) if "l_quantity" in line and "FileScan" in line)
    above = plan.splitlines()[:scan]
    partial = max(i for i, line in enumerate(above) if "partial_sum" in line)
    join = max(i for i, line in enumerate(above) if "Join" in line)
    assert join < partial


def test_metrics_of_one_fact_share_one_scan(spark, sf):
    names = ["result_rows", "valid_rate", "b_total", "b_average", "abc_stddev", "events"]
    plan = plan_of(query(star(spark, sf), names, by=["nation.n_name"]))
    assert plan.count("orders.parquet") == 1
