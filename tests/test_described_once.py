"""The newest traces with a hit are described from their ids alone, without joining the hits a second time."""

import pytest
from conftest import built_traces

from spanloom.operators import traces


@pytest.mark.parametrize("search", [lambda s: traces.error_traces(s, 3), lambda s: traces.search_traces(s, "op-1", 3, errors_only=True)])
def test_one_semi_join_describes(make_spans, search):
    found = search(make_spans(*built_traces(8, failing=lambda i: i % 2 == 1)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    assert [r.trace_id for r in found.collect()] == ["trace_0001", "trace_0003", "trace_0005"]
