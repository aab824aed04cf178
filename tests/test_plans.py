"""Physical plans: no pairings without a key, no row-at-a-time Python, filters at the scan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import rows, validate
from tidewatch.plans import inputs
from tidewatch.sources import tables

SF = "/root/testdata/sf0.001"
PARTS = ["a1_zone_traffic", "w1_detect", "w6_last_windows", "j3_match_dispatches", "j4_nearest_window", "j8_overlapping_events",
         "k1_upsert_replace", "k3_keep_latest", "r1_stitch", "r4_trips", "v1_top_k", "v2_filtered_top_k", "tx3_redact"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PARTS)
def test_no_unkeyed_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(inputs.traffic(spark, SF))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning") > text.index("count(1)")
    assert "customer_email" not in text and "user_id" not in text


def test_top_rows_are_limited_in_each_task(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["w6_last_windows"](spark, SF))
    assert "WindowGroupLimit" in plan(entry.queries()["k3_keep_latest"](spark, SF))
    assert "TakeOrderedAndProject" in plan(entry.queries()["t1_traffic_series"](spark, SF))


def test_filters_reach_the_scan(spark):
    docs = tables.table(spark, SF, "documents")
    assert "IsNotNull(text)" in plan(validate.split(docs, [validate.required("text")])[0])
    events = tables.table(spark, SF, "events").select("event_id", F.col("event_type").alias("zone"))
    assert "In(event_type, [click,view])" in plan(rows.in_zones(events, ["click", "view"]))
    orders = tables.table(spark, SF, "orders").select("o_orderkey", "o_orderdate")
    text = plan(orders.where(F.col("o_orderkey") > 5))
    assert "GreaterThan(o_orderkey,5)" in text


def test_redaction_stays_in_the_jvm(spark):
    text = plan(entry.queries()["tx3_redact"](spark, SF))
    assert "Python" not in text and "Exchange" not in text
