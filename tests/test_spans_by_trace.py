"""Queries that make one row of a trace shuffle orders and lines once, by trace, and nothing after that."""

import pytest

from spanloom.plans import catalog
from spanloom.sources import export
from spanloom.sources.driver_tables import Tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_by_trace_are_the_spans(spark):
    tables = Tables(spark, SF_DIR)
    assert sorted(map(str, tables.spans_by_trace.collect())) == sorted(map(str, tables.spans.select(*tables.spans_by_trace.columns).collect()))


@pytest.mark.parametrize("name", ["b3_otlp_export", "b1_json_traces"])
def test_no_shuffle_after_the_spans(spark, name):
    above, _, below = plan(catalog.CATALOG[name](Tables(spark, SF_DIR))).partition("Union")
    assert below and "Exchange" not in above


def test_otlp_documents_group_by_service(spark, make_spans):
    rows = [("t", f"s{i}", None, service, "op", 10 - i, 5, "internal", "ok", None, {"k": "v"}, {}, {}) for i, service in enumerate(["b", None, "a", "b", None, "c"])]
    [document] = export.otlp_traces(make_spans(*rows)).select("json").collect()
    shape = "resourceSpans array<struct<resource:struct<attributes:array<struct<value:struct<stringValue:string>>>>,scopeSpans:array<struct<spans:array<struct<spanId:string>>>>>>"
    [parsed] = spark.createDataFrame([document]).selectExpr(f"from_json(json, '{shape}') as d").collect()
    got = [(r.resource.attributes[0].value.stringValue, [s.spanId for s in r.scopeSpans[0].spans]) for r in parsed.d.resourceSpans]
    assert got == [(None, ["s4", "s1"]), ("a", ["s2"]), ("b", ["s3", "s0"]), ("c", ["s5"])]
