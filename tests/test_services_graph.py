import random

import pytest
from conftest import MS, built_traces, span

from pyspark.sql import functions as F
from spanloom.functions import quantile as Q
from spanloom.operators import graph, services


def test_rank_percentiles_match_brute_force(spark):
    rng = random.Random(1)
    # One key holds most rows; values cluster in a few buckets and repeat.
    data = [("hot", rng.choice([5, 7, 10**9 + rng.randrange(50), rng.randrange(10**12)])) for _ in range(3000)]
    data += [("cold", 42), ("two", 1), ("two", 9)]
    df = spark.createDataFrame(data, "k string, v long")
    ranks = {
        "p50": Q.percent_index(50), "p95": Q.percent_index(95), "p99": Q.percent_index(99),
        "s0": Q.sample_index(0.0), "s1": Q.sample_index(1.0), "e99": Q.scaled_index(0.99),
    }
    got = {r.k: r for r in Q.rank_quantiles(df, ["k"], "v", ranks, {"n": (F.count(F.lit(1)), F.sum)}).collect()}
    for key in ("hot", "cold", "two"):
        values = sorted(v for k, v in data if k == key)
        n = len(values)
        want = dict(
            p50=values[n // 2], p95=values[n * 95 // 100], p99=values[n * 99 // 100], s0=values[0], s1=values[-1],
            e99=values[min(int(n * 0.99), n - 1)], n=n,
        )
        assert {c: got[key][c] for c in want} == want


def test_sample_percentile_example(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 50)], "value double")
    ranks = {"a": Q.sample_index(0.0), "b": Q.sample_index(0.5), "c": Q.sample_index(1.0)}
    row = Q.rank_quantiles(df, [], "value", ranks, buckets=Q.double_buckets("value")).first()
    assert (row.a, row.b, row.c) == (10.0, 30.0, 50.0)


def test_double_and_time_buckets_match_brute_force(spark):
    rng = random.Random(2)
    doubles = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-3, 12) for _ in range(500)] + [0.0] * 20
    times = [1_700_000_000 * 10**9 + rng.randrange(10**16) for _ in range(499)] + [1_700_000_000 * 10**9] * 21
    df = spark.createDataFrame(list(zip(doubles, times)), "d double, t long")
    ranks = {f"r{p}": Q.sample_index(p / 100) for p in (0, 3, 50, 97, 100)}
    for column, values, buckets in (("d", doubles, Q.double_buckets("d")), ("t", times, Q.time_buckets("t"))):
        row = Q.rank_quantiles(df, [], column, ranks, buckets=buckets).first()
        assert [row[r] for r in ranks] == [sorted(values)[int(519 * p / 100)] for p in (0, 3, 50, 97, 100)]


def test_percentile_95_of_0_to_99(make_spans):
    spans = make_spans(*[span("t", f"s{i}", ms=i) for i in range(100)])
    row = services.service_metrics(spans).first()
    assert (row.p50_ns, row.p95_ns, row.p99_ns) == (50 * MS, 95 * MS, 99 * MS)


def test_service_metric_invariants(make_spans):
    spans = make_spans(*built_traces(7, failing=lambda i: i == 0))
    for r in services.service_metrics(spans).collect():
        assert r.min_ns <= r.p50_ns <= r.p95_ns <= r.p99_ns <= r.max_ns
        assert r.min_ns <= r.avg_ns <= r.max_ns and 0 <= r.error_rate <= 1


def test_requested_order(make_spans):
    metrics = services.service_metrics(make_spans(*built_traces(2)))
    named = services.services_in_order(metrics, ["service-2", "nobody", "api-gateway"]).collect()
    assert [r.service_name for r in named] == ["service-2", "api-gateway"]
    assert services.services_in_order(metrics, []).count() == 4


def test_batch_aggregate_example(spark):
    df = spark.createDataFrame([("s", v) for v in (10.0, 20.0, 30.0, 40.0, float("nan"))], "service_name string, value double")
    row = services.merge_aggregates(services.partial_aggregates(df, ["service_name"]), ["service_name"]).first()
    assert (row["sum"], row["count"], row["min"], row["max"], row["avg"]) == (100.0, 4, 10.0, 40.0, 25.0)


def test_ema_matches_the_fold(spark):
    rng = random.Random(3)
    data = [(k, i, rng.random() * 100) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(data, "k string, i long, v double")
    got = {r.k: r.ema for r in services.latency_ema(df, ["k"], ["i"], "v").collect()}
    for key in ("a", "b"):
        ema = None
        for k, _, v in data:
            if k == key:
                ema = v if ema is None else 0.1 * v + 0.9 * ema
        assert got[key] == pytest.approx(ema)


def test_alerts_need_samples(make_spans):
    few = services.service_metrics(make_spans(span("t", "a", status="error")))
    assert services.alerts(few).count() == 0
    assert services.alerts(few, min_samples=1).first().error_alert


def test_system_health_scale(spark):
    rows = [(100.0, 1.0, 0.0, 1.0), (450.0, 1.0, 0.0, 1.0), (1.0, 1.0, 0.06, 1.0), (1.0, 95.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "memory_mb double, cpu_percent double, error_rate double, query_latency_ms double")
    assert [r.health for r in services.system_health(df).collect()] == ["healthy", "unhealthy", "degraded", "critical"]


def chain():
    return [
        span("t", "1", None, "frontend"), span("t", "2", "1", "backend", start_ms=5, ms=50),
        span("t", "3", "2", "database", start_ms=10, ms=20, status="error"),
    ]


def test_service_map_example(make_spans):
    nodes, edges = graph.service_map(make_spans(*chain()))
    by_name = {n.service_name: n for n in nodes.collect()}
    assert [n.service_name for n in nodes.collect()] == ["frontend", "backend", "database"]
    assert by_name["frontend"].is_root and by_name["database"].is_leaf and by_name["database"].tier == 2
    assert sorted((e["from"], e["to"], e.call_count, e.error_count) for e in edges.collect()) == [
        ("backend", "database", 1, 1), ("frontend", "backend", 1, 0),
    ]


def test_tier_of_unreached_services(spark):
    links = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(links, "from string, to string")
    nodes = spark.createDataFrame([(s, s == "a") for s in "abcxy"], "service_name string, is_root boolean")
    tiers = {r.service_name: r.tier for r in graph.service_tiers(nodes, edges).collect()}
    assert tiers == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3}
    rootless = nodes.withColumn("is_root", F.lit(False))
    assert {r.tier for r in graph.service_tiers(rootless, edges).collect()} == {0}


def test_edge_calls_add_up(make_spans):
    spans = make_spans(*built_traces(4), *chain())
    calls = graph.cross_service_calls(spans)
    edges = graph.service_edges(graph.staged_calls(spans))
    assert edges.agg(F.sum("call_count")).first()[0] == calls.count() == 14


def test_sequential_flow_over_small_chunks(make_spans):
    rows = [span("t", f"s{i:02d}", None, start_ms=3 * i) for i in range(12)]
    rows[4] = span("t", "s04", "s03", start_ms=12)
    got = graph.sequential_flow(make_spans(*rows), gap_ns=1, chunk_rows=2).collect()
    assert [(r.from_span, r.to_span) for r in got] == [("s03", "s04")]
    assert graph.sequential_flow(make_spans(*rows), gap_ns=4 * MS, chunk_rows=2).count() == 11


def test_unusual_paths(spark):
    rows = [(["a", "b", "c"],), (["a", "b", "a"],), ([f"s{i}" for i in range(15)],)]
    df = spark.createDataFrame(rows, "path array<string>")
    assert [r.u for r in df.select(graph.unusual_path().alias("u")).collect()] == [False, True, True]
