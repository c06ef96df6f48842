import json

import pytest
from conftest import BASE_NS, MS, span

from pyspark.sql import functions as F
from spanloom.sources import export, otlp

TRACE, SPAN = "0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331"


def otlp_request(**changes):
    one = {
        "traceId": TRACE.upper(), "spanId": SPAN, "parentSpanId": "0" * 16, "name": "GET /", "kind": 2,
        "startTimeUnixNano": str(BASE_NS), "endTimeUnixNano": str(BASE_NS + 5 * MS),
        "attributes": [
            {"key": "http.method", "value": {"stringValue": "GET"}}, {"key": "n", "value": {"intValue": "7"}},
            {"key": "ok", "value": {"boolValue": True}}, {"key": "half", "value": {"doubleValue": 0.5}},
            {"key": "n", "value": {"intValue": "8"}}, {"key": "none"},
            {"key": "list", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "b"}]}}},
            {"key": "kv", "value": {"kvlistValue": {"values": [{"key": "k", "value": {"doubleValue": 2.0}}]}}},
        ],
        "events": [{"timeUnixNano": "1700000000000000001", "name": "e", "attributes": [{"key": "x", "value": {"bytesValue": "AQID"}}]}],
        "status": {"code": 2, "message": "boom"},
    } | changes
    return {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": [one]}]}]}


@pytest.fixture
def load(spark, tmp_path):
    def _load(*requests, signal="traces"):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(json.dumps(r) for r in requests))
        return otlp.read_otlp(spark, str(path), signal)

    return _load


def test_span_fields(load):
    row = otlp.valid_spans(otlp.validate_spans(otlp.flatten_spans(load(otlp_request())))).first()
    assert (row.trace_id, row.parent_span_id, row.service_name, row.kind) == (TRACE, None, "shop", "server")
    assert (row.duration_ns, row.status, row.status_message) == (5 * MS, "error", "boom")
    assert row.attributes == {
        "span.kind": "server", "http.method": "GET", "n": "7", "ok": "true", "half": "0.5", "list": "[1, b]", "kv": "{k=2}",
        "event.0.name": "e", "event.0.time": "2023-11-14T22:13:20.000000001+00:00", "event.0.x": "bytes(3)",
    }


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"traceId": ""}, "trace_id_empty_or_zero"),
        ({"traceId": "0" * 32}, "trace_id_empty_or_zero"),
        ({"spanId": "0" * 16}, "span_id_empty_or_zero"),
        ({"traceId": "a" * 34}, "trace_id_too_long"),
        ({"startTimeUnixNano": "0"}, "start_time_zero"),
        ({"endTimeUnixNano": "0"}, "end_time_zero"),
        ({"startTimeUnixNano": "915148800000000000"}, "start_time_out_of_range"),
        ({"endTimeUnixNano": str(BASE_NS - 1)}, "end_before_start"),
        ({"endTimeUnixNano": str(BASE_NS + 86_400 * 10**9 + 1)}, "duration_too_long"),
        ({"endTimeUnixNano": str(BASE_NS + 86_400 * 10**9)}, None),
    ],
)
def test_validation(load, change, reason):
    checked = otlp.validate_spans(otlp.flatten_spans(load(otlp_request(**change), otlp_request())))
    assert [r.reject_reason for r in checked.collect()] == [reason, None]
    assert otlp.valid_spans(checked).count() == (2 if reason is None else 1)


def test_missing_parts_default(load):
    bare = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": TRACE, "spanId": SPAN, "startTimeUnixNano": str(BASE_NS), "endTimeUnixNano": str(BASE_NS)}]}]}]}
    row = otlp.flatten_spans(load(bare)).first()
    assert (row.service_name, row.kind, row.status, row.operation_name) == ("unknown", "internal", "unknown", "")
    assert row.attributes == {"span.kind": "internal"}


def test_metric_kinds(load):
    metric = lambda name, kind, **p: {"name": name, kind: {"dataPoints": [{"timeUnixNano": "5", **p}]}}
    request = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        metric("g", "gauge", asDouble=1.5), metric("i", "sum", asInt="3"), metric("h", "histogram", sum=9.0, count="2"),
        metric("h0", "histogram", sum=0.0, count="2"), metric("s", "summary", sum=9.0, count="2"), metric("s0", "summary", sum=9.0, count="0"),
        metric("e", "exponentialHistogram", sum=9.0, count="2"), metric("none", "gauge"),
    ]}]}]}
    rows = otlp.flatten_metrics(load(request, signal="metrics")).collect()
    assert {(r.metric_name, r.value, r.service_name) for r in rows} == {
        ("g", 1.5, "unknown_service"), ("i", 3.0, "unknown_service"), ("h", 9.0, "unknown_service"), ("s", 4.5, "unknown_service"),
    }


def test_log_records(load):
    request = {"resourceLogs": [{"scopeLogs": [{"logRecords": [
        {"timeUnixNano": "7", "severityNumber": 17, "body": {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "1"}}]}}, "traceId": TRACE.upper(), "spanId": ""},
        {"severityNumber": 99},
    ]}]}]}
    first, second = sorted(otlp.flatten_logs(load(request, signal="logs")).collect(), key=lambda r: r.ts_ns)
    assert (first.ts_ns, first.severity, first.body, first.trace_id, first.span_id) == (7, "ERROR", "{a=1}", TRACE, None)
    assert second.ts_ns > 10**18 and (second.severity, second.body, second.attributes) == ("INFO", "", None)


def test_traceparent(spark):
    good = f"00-{TRACE}-{SPAN}-01"
    df = spark.createDataFrame([(good,), (f"01-{TRACE}-{SPAN}-01",), ("00-a-b",), (f"00-{TRACE}-{SPAN}-zz",)], "h string")
    got = [r.p for r in df.select(otlp.parse_traceparent("h").alias("p")).collect()]
    assert tuple(got[0]) == (TRACE, SPAN, 1) and got[1:] == [None, None, None]
    made = df.limit(1).select(otlp.create_traceparent(F.lit(TRACE), F.lit(SPAN), F.lit(True)).alias("h")).first().h
    assert made == good


def test_later_arrival_replaces(make_spans):
    old = make_spans(span("t", "a"), span("t", "b")).withColumn("arrival", F.lit(1))
    new = make_spans(span("t", "a", status="error")).withColumn("arrival", F.lit(2))
    got = {r.span_id: r.status for r in otlp.latest_spans(old.unionByName(new), "arrival").collect()}
    assert got == {"a": "error", "b": "ok"}


def test_large_traces_are_exported_in_parts(make_spans):
    spans = make_spans(*[span("big", f"s{i}") for i in range(50)], span("small", "x"))
    parts = export.with_parts(spans, 5).groupBy("trace_id", "part", "part_count").count().collect()
    assert {r.part_count for r in parts} == {5}
    assert sum(r["count"] for r in parts if r.trace_id == "big") == 50
    assert len([r for r in parts if r.trace_id == "big"]) == 5
    whole = export.jaeger_traces(spans).groupBy("trace_id").count().collect()
    assert {r["count"] for r in whole} == {1}
    assert export.jaeger_traces(spans, 5).where("trace_id = 'big'").count() == 5


def test_export_layouts(make_spans):
    spans = make_spans(span(TRACE, "a", None, "x", ms=2), span(TRACE, "b", "a", "y", 'op "q", 1', 1, 1, "error", k="v"))
    jaeger = json.loads(export.jaeger_traces(spans).first().json)
    second = jaeger["spans"][1]
    assert second["references"][0]["refType"] == "CHILD_OF" and second["duration"] == 1000
    assert {"key": "error", "type": "bool", "value": True} in second["tags"]
    assert set(jaeger["processes"]) == {"x", "y"} and jaeger["spans"][0]["references"] == []
    headers, chosen = export.select_traces(spans)
    native = json.loads(export.json_traces(headers, chosen).first().json)
    assert native["has_error"] and [s["span_id"] for s in native["spans"]] == ["a", "b"]
    assert export.select_traces(spans, errors_only=True)[1].count() == 2
    with pytest.raises(LookupError):
        export.one_trace(spans, "nope")


def test_csv_round_trip_keeps_quotes(spark, make_spans, tmp_path):
    path = str(tmp_path / "csv")
    export.write_csv(make_spans(span("t", "a", operation='say "hi", twice', k='va"l')), path)
    row = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert row.operation == 'say "hi", twice' and json.loads(row.attributes) == {"k": 'va"l'} and row.status == "OK"


@pytest.mark.parametrize("level", sorted(export.CODECS))
def test_partitioned_tables(spark, make_spans, tmp_path, level):
    path = str(tmp_path / "spans")
    spans = make_spans(span("t", "a"), span("t", "b", start_ms=86_400_000), span("u", "c"))
    export.write_spans(spans, path, "day", level, files_per_key=2)
    back = spark.read.option("mergeSchema", False).parquet(path)
    assert back.count() == 3 and back.select("dt").distinct().count() == 2
    assert back.filter("dt = 20231114").count() == 2


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    good = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"0af7651916cd43dd8448eb211c80319c","spanId":"b7ad6b7169203331"}]}]}]}'
    lines = [good, good[:50], "[1, 2]", "no json", '"text"', "", "{}"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    texts = otlp.read_lines(spark, str(tmp_path))
    bad = otlp.malformed_requests(texts, "line")
    assert {r.line for r in bad.collect()} == {good[:50], "[1, 2]", "no json", '"text"'}
    assert all(r.source.endswith("in.jsonl") and r.reject_reason == "malformed_request" for r in bad.collect())
    assert otlp.parse_otlp(texts, "line").count() + bad.count() == texts.count() == 6
    assert otlp.flatten_spans(otlp.read_otlp(spark, str(tmp_path))).count() == 1


def test_ids_must_be_hexadecimal(spark):
    request = (
        '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"%s","spanId":"%s","parentSpanId":"%s",'
        '"startTimeUnixNano":"1700000000000000000","endTimeUnixNano":"1700000000000000001"}]}]}]}'
    )
    ids = [("zz", "1", ""), ("1", "x", ""), ("1", "2", "y-"), ("AB", "CD", "EF")]
    df = spark.createDataFrame([(request % i,) for i in ids], "json string")
    checked = otlp.validate_spans(otlp.flatten_spans(otlp.parse_otlp(df, "json")))
    assert [r.reject_reason for r in checked.collect()] == ["trace_id_not_hex", "span_id_not_hex", "parent_span_id_not_hex", None]
