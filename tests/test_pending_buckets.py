"""A bucket's calls to the state store don't grow with its traces; numbers come back exactly."""

import pandas as pd
from conftest import span
from test_pending import SECOND, plain, received

from spanloom.streaming import jobs, pending


class Handle:
    """Lists in memory that count their calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getListState(self, name, schema):
        handle, held = self, []

        class State:
            def get(self):
                handle.calls += 1
                return iter(list(held))

            def appendValue(self, row):
                handle.calls += 1
                held.append(row)

            def clear(self):
                handle.calls += 1
                held.clear()

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def _calls(traces):
    names = ["trace_id", "service_name"]
    state = pending.PendingTraces(names, ["b", *names, "_arrival_ms", "_drawn", "_failed", "_length_ns"], 30, 600)
    state.init(handle := Handle())
    rows = pd.DataFrame([(0, str(i), "a", i % 2 * 100, False, i == 0, 5) for i in range(traces)])
    assert not list(state.handleInputRows((0,), iter([rows.copy()]), None))
    (early,) = state.handleExpiredTimer((0,), Watermark(50), None)
    assert set(early["trace_id"]) == {str(i) for i in range(0, traces, 2)} and (early["reason"] == "error").sum() == 1
    (late,) = state.handleInputRows((0,), iter([rows.copy()]), None)
    assert len(late) == len(early) and late["late"].all()
    (rest,) = state.handleExpiredTimer((0,), Watermark(150), None)
    assert len(rest) == 2 * (traces - len(early))
    return handle.calls


def test_calls_do_not_grow_with_traces():
    assert _calls(10) == _calls(1000) < 30


def test_numbers_stay_exact_beside_nulls(spark, tmp_path):
    exact = 2**60 + 1
    some, none = list(plain("t", "1", 0)), list(plain("t", "2", 0))
    some[0], none[0] = (*span("t", "1")[:6], exact, *span("t", "1")[7:]), (*span("t", "2")[:6], None, *span("t", "2")[7:])
    stream = received(spark, str(tmp_path / "in"), [tuple(some), tuple(none)], [plain("x", "1", 100 * SECOND)], [plain("x", "2", 101 * SECOND)])
    got = jobs.drained(pending.released_spans(stream, "received_time")).filter("trace_id = 't'").collect()
    assert {(r.span_id, r.duration_ns) for r in got} == {("1", exact), ("2", None)}
