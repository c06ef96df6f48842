"""The kept trace summary against the same questions asked of the spans."""

import random

import pytest
from conftest import BASE_NS, span
from pyspark.sql import functions as F

from spanloom.operators import summary_store as store
from spanloom.operators import traces

DAY_MS = 86_400_000


@pytest.fixture(scope="module")
def spans(make_spans):
    """Traces over forty days; some reach over midnight, some begin earlier than their first delivered span."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        at = -r.randrange(40 * DAY_MS)
        root = None if i % 7 else "missing"
        rows += [span(f"t{i:03d}", f"{i}r", root, r.choice(["api", "web"]), "root", at, 50)]
        for c in range(r.randrange(4)):
            late = r.choice([5, 2 * DAY_MS, -DAY_MS])
            rows.append(span(f"t{i:03d}", f"{i}{c}", f"{i}r", r.choice(["api", "db", "web"]), f"op{c}", at + late, r.choice([10, 2000]), r.choice(["ok", "ok", "error"])))
    return make_spans(*rows).drop("attributes", "tags", "resource_attributes").repartition(4)


@pytest.fixture(scope="module")
def kept(spark, spans, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kept") / "summary")
    for k in range(3):
        batch = spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(3)) == k)
        store.update(batch, path, k)
        if k != 1:
            store.update(batch, path, k)  # a repetition counts nothing twice
    store.update(spans.limit(0), path, 3)
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_states_equal_the_summary(spark, spans, kept):
    got = store.kept_summary(spark, kept).drop("dt", "last_start_ns")
    want = traces.trace_summary(spans).select(*got.columns)
    assert sorted(rows(got)) == sorted(rows(want))


@pytest.mark.parametrize("limit", [1, 7, 50, 119, 500])
def test_newest(spark, spans, kept, limit):
    assert rows(store.recent_traces(spark, kept, limit)) == rows(traces.recent_traces(spans, limit))
    assert rows(store.recent_traces(spark, kept, limit, "db")) == rows(traces.recent_traces(spans, limit, "db"))
    assert rows(store.error_traces(spark, kept, limit)) == rows(traces.error_traces(spans, limit))


@pytest.mark.parametrize("service,match", [(None, "all"), ("api", "all"), ("api", "any")])
def test_lists(spark, spans, kept, service, match):
    for low, high in ((None, None), (BASE_NS - 20 * DAY_MS * 10**6, None), (BASE_NS - 30 * DAY_MS * 10**6, BASE_NS - 5 * DAY_MS * 10**6)):
        for limit in (5, 300):
            got = store.list_traces(spark, kept, service, low, high, limit, match)
            assert rows(got) == rows(traces.list_traces(spans, service, low, high, limit, match))


def test_only_the_newest_days_are_read(spark, kept):
    plan = store.recent_traces(spark, kept, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan.split("PartitionFilters")[1][:60]


def test_a_bounded_search_for_known_traces(spark, spans, tmp_path):
    path = str(tmp_path / "summary")
    for k in range(2):
        store.update(spans.filter(F.pmod(F.xxhash64("span_id"), F.lit(2)) == k), path, k, reach_days=3, unit="month")
    got = store.kept_summary(spark, path).drop("dt", "last_start_ns")
    assert sorted(rows(got)) == sorted(rows(traces.trace_summary(spans).select(*got.columns)))


def test_an_empty_store(spark, spans, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.recent_traces(spark, str(tmp_path / "nothing"))
    store.update(spans.limit(0), str(tmp_path / "s"), 0)
    store.update(spans, str(tmp_path / "s"), 1)
    assert store.kept_summary(spark, str(tmp_path / "s")).count() == 120
