"""Spans that are needed several times are made once, and travel as plain columns."""

from spanloom.plans import catalog
from spanloom.sources import export
from spanloom.sources.driver_tables import Tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_jaeger_spans_travel_once(spark, make_spans):
    spans = make_spans(("t", "s", None, "api", "op", 1, 1, "internal", "ok", None, {}, {}, {}))
    text = plan(export.jaeger_traces(spans, 4))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_COL" in text


def test_dependencies_read_written_spans(spark, monkeypatch):
    seen, whole = [], catalog.graph.staged_calls
    monkeypatch.setattr(catalog.graph, "staged_calls", lambda spans: seen.append(spans) or whole(spans))
    catalog.CATALOG["h7_dependencies"](Tables(spark, SF_DIR))
    assert len(seen) == 1 and "Exchange" not in plan(seen[0])
