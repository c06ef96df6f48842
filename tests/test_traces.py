import pytest
from conftest import BASE_NS, MS, built_traces, span

from spanloom.operators import filters as flt
from spanloom.operators import traces
from spanloom.operators.filters import field


def test_recent_traces(make_spans):
    rows = traces.recent_traces(make_spans(*built_traces(5)), 10).collect()
    assert [r.trace_id for r in rows] == [f"trace_{i:04d}" for i in range(5)]
    assert {r.span_count for r in rows} == {4} and {r.root_service for r in rows} == {"api-gateway"}


def test_error_traces(make_spans):
    spans = make_spans(*built_traces(5, failing=lambda i: i % 2 == 0))
    rows = traces.error_traces(spans).collect()
    assert len(rows) == 3 and all(r.has_error for r in rows)


def test_slow_traces_longest_first(make_spans):
    spans = make_spans(*built_traces(5, root_ms=lambda i: 50 * (i + 1)))
    rows = traces.slow_traces(spans, 100 * MS, 10).collect()
    assert len(rows) >= 3
    durations = [r.duration_ns for r in rows]
    assert durations == sorted(durations, reverse=True)


def test_search_by_operation_and_attribute(make_spans):
    spans = make_spans(
        span("t1", "a", operation="Special-Op", special="true"), span("t2", "b", user__id="user1"), span("t3", "c")
    )
    assert [r.trace_id for r in traces.search_traces(spans, "special-op").collect()] == ["t1"]
    assert [r.trace_id for r in traces.search_traces(spans, "USER1").collect()] == ["t2"]
    assert traces.search_spans(spans, "user1", attribute_key="special").count() == 0


def test_extent_and_longest_span_differ(make_spans):
    spans = make_spans(span("t", "a", ms=50), span("t", "b", start_ms=100, ms=50))
    assert traces.recent_traces(spans).first().duration_ns == 150 * MS
    assert traces.list_traces(spans).first().duration_ns == 50 * MS


def test_orphans_form_a_trace(make_spans):
    spans = make_spans(*[span("t", f"c{i}", "gone", f"svc{i}", start_ms=i) for i in range(3)])
    recent = traces.recent_traces(spans).first()
    assert (recent.span_count, recent.root_service) == (3, "svc0")
    assert traces.list_traces(spans).first().root_service == "unknown"


def test_list_traces_asks_every_span_or_any(make_spans):
    spans = make_spans(span("t", "a", service="x"), span("t", "b", "a", "y"))
    assert traces.list_traces(spans, "x").count() == 0
    assert traces.list_traces(spans, "x", service_match="any").count() == 1
    assert traces.list_traces(spans, None, BASE_NS, BASE_NS).count() == 1
    assert traces.list_traces(spans, None, BASE_NS + 1, None).count() == 0


def test_limits():
    assert (traces.checked_limit(None), traces.checked_limit(5)) == (100, 5)
    with pytest.raises(ValueError):
        traces.checked_limit(5000)


def test_filter_modes(make_spans):
    spans = make_spans(span("t", "a", service="x", ms=10), span("t", "b", service="y", ms=500))
    wanted = (field.service == "x") & (field.duration > "100ms")
    assert flt.matching_traces(spans, wanted).count() == 1
    assert flt.matching_traces(spans, wanted, mode="span").count() == 0


def test_filter_values(make_spans):
    spans = make_spans(
        span("t1", "a", status="unset", http__status_code=500, cache__hit="true"),
        span("t2", "b", "a", http__status_code="oops"),
    )
    ids = lambda f: sorted(r.trace_id for r in flt.matching_traces(spans, f).collect())
    assert ids(field.attr("http.status_code") >= 400) == ["t1"]
    assert ids(field.attr("cache.hit") == True) == ["t1"]  # noqa: E712
    assert ids(field.attr("absent") != "x") == []
    assert ids(field.status == "unknown") == ["t1"]
    assert ids(field.parent_span_id == "a") == ["t2"]
    assert ids(flt.everything()) == ["t1", "t2"]
    assert ids((field.name.matches("^o")) & (field.operation.contains("p"))) == ["t1", "t2"]


def test_duration_compares_whole_microseconds(make_spans):
    rows = list(span("t", "a"))
    rows[6] = 1_999
    spans = make_spans(tuple(rows))
    assert flt.matching_traces(spans, field.duration == "1us").count() == 1


def test_envelope_counts_before_the_limit(make_spans):
    rows = flt.run_filter(make_spans(*built_traces(5)), field.service == "api-gateway", limit=2).collect()
    assert len(rows) == 2 and rows[0].total_matches == 5 and rows[0].limited
    assert len(rows[0].trace_id) == 32


def test_single_and_empty_inputs(make_spans):
    assert traces.recent_traces(make_spans(span("t", "a")).limit(0)).count() == 0
    assert traces.dashboard(traces.trace_summary(make_spans(span("t", "a")))).first().traces == 1
