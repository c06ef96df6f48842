"""The smart policy against its budget, against a loop over the traces."""

import random

import pytest

from spanloom.operators import sampling

COLUMNS = "trace_id string, start_ns long, has_error boolean, duration_ms long, is_anomalous boolean, span_count long, bytes long"


def plain(rows, budget, used):
    """One trace after the other, as they start."""
    out = {}
    for trace, _, failed, ms, odd, size, reason in sorted(rows, key=lambda r: (r[1], r[0])):
        always = "error" if failed else "slow" if ms > 1000 else "anomalous" if odd else None
        if always is None:
            always = "over_budget" if used >= budget - budget // 5 else reason
        out[trace] = (always, always not in ("over_budget", "not_sampled"))
        used += size if out[trace][1] else 0
    return out


@pytest.mark.parametrize("budget,used", [(10**9, 0), (40_000, 0), (40_000, 20_000), (40_000, 32_000), (1, 0), (0, 0)])
def test_budget_in_start_order(spark, budget, used):
    r = random.Random(8)
    rows = [
        (f"t{i}", r.randrange(50), r.random() < 0.1, r.choice([10, 10, 2000]) if r.random() < 0.2 else 5, r.random() < 0.05, r.choice([1, 200]), r.randrange(1, 900))
        for i in range(400)
    ]
    features = sampling.with_priority(spark.createDataFrame(rows, COLUMNS))
    drawn = {x.trace_id: x.reason for x in sampling.smart_decisions(features).collect()}
    got = {x.trace_id: (x.reason, x.keep) for x in sampling.budgeted_decisions(features, budget, used).collect()}
    assert got == plain([(*x[:5], x[6], drawn[x[0]]) for x in rows], budget, used)
    if budget == 40_000 and used == 0:
        assert {x[0] for x in got.values()} >= {"error", "slow", "sampled", "not_sampled", "over_budget"}
