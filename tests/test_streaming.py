import json

from conftest import BASE_NS, MS, built_traces, span
from test_sources import SPAN, TRACE, otlp_request

from pyspark.sql import functions as F
from spanloom import schema
from spanloom.operators import graph, sampling, services, traces
from spanloom.sources import otlp
from spanloom.streaming import jobs


def stream_of(spark, tmp_path, df, name="in"):
    path = str(tmp_path / name)
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_ingest_splits_good_and_bad(spark, tmp_path):
    source = tmp_path / "otlp"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in (otlp_request(), otlp_request(startTimeUnixNano="0"))))
    requests = otlp.read_otlp(spark, str(source), stream=True)
    jobs.start_ingest(requests, str(tmp_path / "out"), str(tmp_path / "cp"), interval=None).awaitTermination()
    good, bad = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("spans", "rejected"))
    assert [(r.trace_id, r.span_id) for r in good.collect()] == [(TRACE, SPAN)]
    assert [r.reject_reason for r in bad.collect()] == ["start_time_zero"]


def test_running_metrics_over_batches_equal_batch(spark, make_spans, tmp_path):
    spans = make_spans(*built_traces(6, failing=lambda i: i % 2 == 0))
    path = str(tmp_path / "in")
    for i in range(3):
        spans.filter(F.pmod(F.hash("span_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = services.running_rates(jobs.drained(jobs.live_metrics(stream), "update", ["service_name"])).orderBy("service_name")
    want = services.running_rates(services.running_metrics(spans)).orderBy("service_name")
    assert got.collect() == want.collect()


def test_tail_sampling_decides_closed_sessions(spark, make_spans, tmp_path):
    rows = [span("a", "1", status="error"), span("a", "2", start_ms=10_000), span("b", "3", ms=5), span("last", "9", start_ms=600_000)]
    stream = stream_of(spark, tmp_path, make_spans(*rows))
    got = {r.trace_id: (r.span_count, r.has_error) for r in jobs.drained(jobs.tail_sampling(stream)).collect()}
    assert got == {"a": (2, True), "b": (1, False)}


def test_duplicates_are_dropped(spark, make_spans, tmp_path):
    df = make_spans(span("t", "a"), span("t", "a"), span("u", "a"))
    assert jobs.drained(jobs.deduplicated(stream_of(spark, tmp_path, df))).count() == 2


def test_live_calls_equal_batch(spark, make_spans, tmp_path):
    spans = make_spans(*built_traces(5))
    got = jobs.drained(jobs.live_calls(stream_of(spark, tmp_path, spans)))
    assert got.count() == graph.cross_service_calls(spans).count() == 15


def test_event_feed(spark, make_spans, tmp_path):
    stream = stream_of(spark, tmp_path, make_spans(*built_traces(3)))
    jobs.start_event_feed(stream, str(tmp_path / "feed"), str(tmp_path / "cp"), None).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "feed")).collect()
    assert {(r.service_name, r.span_count) for r in rows} == {("api-gateway", 4)} and len(rows) == 3


def test_adaptive_rate_state_survives_batches(spark, tmp_path):
    path, rows = str(tmp_path / "load"), [(i, 100.0, 0.0) for i in range(4)]
    for row in rows:
        spark.createDataFrame([row], "interval long, tps double, error_rate double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("interval long, tps double, error_rate double").option("maxFilesPerTrigger", 1).parquet(path)
    rates = sorted(r.rate for r in jobs.drained(jobs.adaptive_rate(stream)).collect())
    batch = sampling.adaptive_rates(spark.read.parquet(path)).orderBy("interval")
    assert rates == [r.rate for r in batch.collect()] == [150, 225, 337, 505]


def test_streaming_ema(spark, tmp_path):
    path = str(tmp_path / "v")
    for i, v in enumerate((100.0, 200.0)):
        spark.createDataFrame([("k", i, v)], "k string, i long, v double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, i long, v double").option("maxFilesPerTrigger", 1).parquet(path)
    ema = jobs.drained(jobs.latency_ema(stream, "k", "v", "i"), "update", ["key"]).first().ema
    assert abs(ema - 110.0) < 1e-9


def test_metric_windows_close_by_watermark(spark, tmp_path):
    minute = 60 * 10**9
    rows = [(BASE_NS // minute * minute + i * minute, "s", "m", 1500.0) for i in range(10)]
    stream = stream_of(spark, tmp_path, spark.createDataFrame(rows, schema.METRIC_POINT))
    assert jobs.drained(jobs.metric_windows(stream)).count() == 4
