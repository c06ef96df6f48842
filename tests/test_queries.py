"""Registered queries against their SQL. All of them run with ALL_QUERIES=1, else one per family."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SHORT = """a1_otlp_round_trip a2_otlp_metrics a8_validation b2_jaeger c13_grouping c16_envelope d7_search_spans d9_exact_counts
g1_trace_summary g2_recent_traces g5_list_traces g7_slow_traces g9_dashboard j1_service_metrics j14_merge_partials
j18_latency_ema h2_service_edges h4_service_tiers h8_path_links h11_sequential_flow w1_newest_per_service w3_error_clusters
w5_anomalies f9_tokens f11_pattern_positions k2_minute_windows k3_rolling_health l1_search_documents l6_retain_logs
v1_span_depth v3_self_times v5_preorder v7_time_histogram p4_tail_decisions p6_adaptive_rates p8_budget_plan
x4_keep_newest q2_metric_windows q3_tail_sampling d1_root_span_by_id l8_trace_context v5_positions p5_budgeted b8_written_tiers
x6_maintain_table g2_kept_recent""".split()
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SHORT


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(df, con, sql) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "service_name" and df.count() == 22
