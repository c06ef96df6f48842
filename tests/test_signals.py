import math

import pytest
from conftest import BASE_NS, span

from pyspark.sql import functions as F
from spanloom import schema
from spanloom.functions import scalars as S
from spanloom.operators import logs, metrics, sampling, traces


def points(spark, *values, service="s", step_ns=10**9):
    rows = [(BASE_NS // (60 * 10**9) * 60 * 10**9 + i * step_ns, service, "m", float(v)) for i, v in enumerate(values)]
    return metrics.with_event_time(spark.createDataFrame(rows, schema.METRIC_POINT))


def health(df):
    return metrics.current_health(metrics.rolling_health(metrics.minute_windows(df))).first()


def test_health_examples(spark):
    fine = health(points(spark, 1500, 1200, 1800))
    assert (fine.error_rate, fine.avg_latency_ms) == (0.0, 1500.0)
    mixed = health(points(spark, 1200, 0.8, 1400, 0.9))
    assert (mixed.error_rate, mixed.avg_latency_ms) == (50.0, 1300.0)


def test_point_classes_at_the_bounds(spark):
    df = metrics.classify_points(points(spark, 1000.0, 1000.1, 0.5, 1.0, math.nan))
    flags = [(r.is_latency, r.is_error) for r in df.orderBy("ts_ns").collect()]
    assert flags[:4] == [(False, False), (True, False), (False, False), (False, True)]
    assert health(points(spark, 1500, math.nan)).avg_latency_ms == 1500.0


def test_rolling_health_keeps_five_previous_windows(spark):
    df = points(spark, *[1500] * 8, step_ns=60 * 10**9)
    last = health(df)
    assert last.requests == 6 and last.request_rate == pytest.approx(6 / 360)


def test_service_cap(spark):
    df = points(spark, 1, service="a").unionByName(points(spark, 1, 2, service="b").withColumn("ts_ns", F.col("ts_ns") + 1))
    got = {(r.service_name, r.rejected) for r in metrics.cap_services(df, max_services=1).collect()}
    assert got == {("a", False), ("b", True)}


def log_rows(spark, *rows):
    data = [(i, BASE_NS + i, "s", None, None, sev, body, None) for i, (sev, body) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "event_id long, ts_ns long, service_name string, trace_id string, span_id string, severity string, body string, attributes map<string,string>",
    )


def test_log_search_examples(spark):
    df = log_rows(spark, ("INFO", "Database connection ok"), ("ERROR", "error in database"), ("INFO", "user login"))
    assert logs.search_logs(df, "database").count() == 2
    assert logs.search_logs(df, "error").count() == 1
    assert logs.search_logs(df, "data").count() == 0
    assert [r.event_id for r in logs.search_logs(df, "LOGIN database").collect()] == [2, 1, 0]
    assert logs.search_logs(df, "in ok").count() == 0
    assert logs.search_logs(df, "").count() == 0
    assert [r.event_id for r in logs.search_index(logs.token_index(df), "login database").collect()] == [2, 1, 0]


def test_token_tests_agree(spark):
    bodies = ["a.foo_bar", "FOO", "xfoo", "foo-1", "füür foo", "", "bar\nfoo\nbaz", "föo"]
    df = log_rows(spark, *[("INFO", b) for b in bodies])
    by_regex = df.select("event_id", logs.has_token("foo föo füür").alias("hit"))
    by_tokens = df.select(F.arrays_overlap(S.tokens("body"), F.array(*[F.lit(w) for w in ("foo", "föo", "füür")])).alias("hit"))
    assert [r.hit for r in by_regex.collect()] == [r.hit for r in by_tokens.collect()]


def test_severity_and_retention(spark):
    df = log_rows(spark, *[(s, f"Log {i}") for i, s in enumerate(("DEBUG", "INFO", "WARN", "ERROR", "INFO"))])
    assert logs.recent_logs(df, 10, "WARN").count() == 2 and logs.recent_logs(df, 10, "error").count() == 1
    assert logs.recent_logs(df, 10, "whatever").count() == 5
    assert sorted(r.body for r in logs.retain_logs(df, 3).collect()) == ["Log 2", "Log 3", "Log 4"]
    counts = {r.severity: r.logs for r in logs.severity_counts(df).collect()}
    assert counts == {"DEBUG": 1, "INFO": 2, "WARN": 1, "ERROR": 1}


def test_pattern_positions_overlap_and_count_bytes(spark):
    df = spark.createDataFrame([("aaa",), ("éaaé aa",), ("none",), ("",)], "body string")
    got = [r.p for r in df.select(S.pattern_positions("aa", "body").alias("p")).collect()]
    assert got == [[0, 1], [2, 7], [], []]


def test_time_bounds():
    as_of = 10**18
    assert S.parse_time_bound_ns("30m", as_of) == as_of - 30 * S.NS_PER_MIN
    assert S.parse_time_bound_ns("1700000000", as_of) == 1_700_000_000 * 10**9
    assert S.parse_time_bound_ns("1700000000000000001", as_of) == 1_700_000_000_000_000_001
    assert S.parse_time_bound_ns("1970-01-01T00:00:01Z", as_of) == 10**9
    assert S.parse_duration_ns("100ms") == 10**8 and S.parse_duration_ns("5m") == 300 * 10**9
    with pytest.raises(ValueError):
        S.parse_duration_ns("fast")


def decide(make_spans, *rows):
    return {r.trace_id: r for r in sampling.tail_decisions(traces.trace_features(make_spans(*rows))).collect()}


def test_tail_sampling_examples(make_spans):
    got = decide(
        make_spans,
        span("err", "a", status="error"), span("slow", "b", ms=2000),
        *[span("big", f"s{i}") for i in range(150)], *[span("wide", f"w{i}", service=f"s{i}") for i in range(6)],
    )
    assert {t: got[t].reason for t in ("err", "slow", "big", "wide")} == {
        "err": "error", "slow": "slow", "big": "complex", "wide": "wide",
    }
    normal = decide(make_spans, *[span(f"n{i}", "a") for i in range(1000)])
    assert 1 <= sum(r.keep for r in normal.values()) <= 49


def test_head_decisions_at_the_default_rate_never_defer(make_spans):
    spans = make_spans(*[span(f"n{i}", "a") for i in range(500)])
    got = {r.d for r in spans.select(sampling.head_decision().alias("d")).collect()}
    assert got <= {"keep", "drop"}


def test_service_rates(make_spans):
    spans = make_spans(*[span(f"t{i}", f"s{i}", service=s) for i in range(400) for s in ("always", "never", "half")])
    kept = {r.service_name: r["count"] for r in sampling.service_rates(spans, {"always": 1.0, "never": 0.0}, 0.5).groupBy("service_name").count().collect()}
    assert kept["always"] == 400 and "never" not in kept and 120 <= kept["half"] <= 280


def test_anomaly_examples(spark):
    rows = [(f"t{i:03d}", i, False, 5, 2, 100 + i % 20, "api") for i in range(150)]
    rows += [("slow", 1000, False, 5, 2, 6000, "api"), ("huge", 1001, False, 600, 2, 105, "api"), ("fan", 1002, False, 5, 11, 105, "api")]
    rows += [("spike", 1003, False, 5, 2, 2500, "api"), ("wide", 1004, False, 60, 2, 105, "api")]
    df = spark.createDataFrame(rows, "trace_id string, start_ns long, has_error boolean, span_count long, service_count long, duration_ms long, root_service string")
    got = {r.trace_id: r for r in sampling.with_anomaly(df, chunk_rows=1000).collect()}
    assert got["slow"].odd_duration and got["huge"].odd_size and got["fan"].odd_fan_out and got["wide"].odd_size
    assert not any(got[f"t{i:03d}"].is_anomalous for i in range(150))


def test_adaptive_rate_steps():
    assert sampling.next_rate(100, 100.0, 0.0) == 150
    assert sampling.next_rate(100, 10_000.0, 0.0) == 50
    assert sampling.next_rate(100, 1000.0, 0.1) == 1000
    assert sampling.next_rate(9000, 100.0, 0.1) == 10_000
    assert sampling.next_rate(1, 10**9, 0.0) == 1


def test_budget(spark):
    gb = 10**9
    assert sampling.has_capacity(100 * gb, 50 * gb) and not sampling.has_capacity(100 * gb, 85 * gb)
    for used, tiers in ((50, {"critical", "high", "medium"}), (85, {"critical"})):
        sized = spark.createDataFrame(
            [(t, t, 0, 1000) for t in ("critical", "high", "medium", "low", "minimal")], "trace_id string, priority string, start_ns long, bytes long"
        )
        plan = sampling.budget_plan(sized, 100 * gb, used * gb)
        assert {r.priority for r in plan.filter("admitted").collect()} == tiers
    for used, free in ((50, 0), (85, 10), (95, 20)):
        sized = spark.createDataFrame([("t", 0, used * gb)], "trace_id string, start_ns long, bytes long")
        assert sampling.budget_statistics(sized, 100 * gb).first().cleanup_bytes == free * gb


def test_every_error_trace_is_kept(make_spans):
    rows = [span(f"t{i}", "a", status="error" if i % 3 == 0 else "ok") for i in range(60)]
    got = decide(make_spans, *rows)
    assert all(got[f"t{i}"].keep for i in range(0, 60, 3))
