"""Queries that keep tables between steps, where the master is not local."""

import pytest
from oracle import duck, spark_rows

import __spark_entry__ as entry
from tidewatch.session import scratch

SF = "/root/testdata/sf0.001"
QUERIES = [
    "op2_sharding",
    "op3_decontamination",
    "op4_line_dedup",
    "op5_quotation_linking",
    "op7_near_join",
    "op8_url_filter",
    "op9_packing",
    "op10_near_vectors",
    "op11_vector_codes",
    "op12_alignment",
    "op13_quality_rules",
    "a7_running_counters",
    "a8_running_latest",
    "dsp2_completed_actions",
    "a7_stage_counters",
    "dsp3_vessels_after_dispatch",
    "dsp_plan",
    "g1_change_capture",
    "f1_surges_only",
    "j1_lateral_call_left",
    "j1_lateral_call",
    "j5_stream_enrichment",
    "k6_drop_by_manifest",
    "j7_nearest_point",
    "j8_overlapping_events",
    "k9_offer_once",
    "m1_embed",
    "m3_dispatch_request",
    "m3_surge_query",
    "m4_rule_explanation",
    "p9_anomaly_cards",
    "r4_trips",
    "r5_positions",
    "s10_write_accounting",
]


@pytest.mark.parametrize("name", QUERIES)
def test_runs_on_a_cluster(spark, monkeypatch, name):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with scratch(spark):
        df = entry.queries()[name](spark, SF)
        if name in entry.oracle_sql():
            assert spark_rows(df) == duck(SF, entry.oracle_sql()[name])
        else:
            assert df.count() > 0
