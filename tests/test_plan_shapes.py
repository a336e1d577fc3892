"""Physical plans: pruned scans, few shuffles, no cross joins."""

import os

import pytest

from seriesloom.operators import causality, series
from workload import queries, tables

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan_of(df, final=False):
    if final:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange")


def test_causality_shuffles_the_rows_once(spark):
    events = tables.event_rows(spark, SF)
    plan = plan_of(causality.granger_scan(
        events, ["event_type"], ["ts", "event_id"], "user_id", "value", max_rows=None), final=True)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(event_type" in line
                 and "ReusedExchange" not in line and "__n" not in line]
    assert len(exchanges) == 1 and "ReusedExchange" in plan


def test_collected_series_need_no_second_shuffle(spark):
    events = tables.event_rows(spark, SF)
    plan = plan_of(series.collect_series(events, ["event_type"], ["ts", "event_id"], ["value"], max_rows=None))
    assert plan.count("Exchange hashpartitioning") == 1


def test_flights_are_not_shuffled_for_small_dimensions(spark):
    plan = plan_of(tables.air_traffic(spark, SF))
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(tables.daily_orders(spark, SF))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan


def test_filter_reaches_the_scan(spark):
    plan = plan_of(queries.drop_nulls(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


@pytest.mark.parametrize("name", ["minmax_normalize", "unmatched_keys", "profile", "inbound_with_cases"])
def test_no_cross_joins(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_series_never_meet_in_one_window(spark, monkeypatch):
    """With a low limit, the rows that reach the per-key window are the block borders only."""
    seen = {}
    original = series.over_long

    def watched(*args, **kwargs):
        inner, border = original(*args, **kwargs)
        seen["inner"], seen["border"] = inner.count(), border.count()
        return inner, border

    monkeypatch.setattr(series, "over_long", watched)
    events = tables.event_rows(spark, SF)
    out = series.growth(events, ["event_type"], ["ts", "event_id"], "value", max_rows=50)
    assert out.count() == events.count() == seen["inner"] + seen["border"]
    assert seen["border"] < seen["inner"] / 10


def test_flights_do_not_move_to_meet_the_cases(spark):
    plan = plan_of(queries.inbound_with_cases(spark, SF))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins if "SortMergeJoin" in line or "Broadcast" in line)
    assert "SortMergeJoin" not in plan


def test_repeated_dictionary_words_are_combined_before_the_shuffle(spark):
    plan = plan_of(queries.QUERIES["unmatched_labels"](spark, SF))
    assert plan.count("HashAggregate") >= 4
