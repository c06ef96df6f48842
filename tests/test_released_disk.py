import pickle
from pathlib import Path

import pandas as pd

from spanloom.plans import catalog
from spanloom.session import shared_dir
from spanloom.sources.driver_tables import Tables
from spanloom.streaming import pending


def test_received_files_are_neither_copied_nor_left(spark):
    there = lambda: {p for n in ("received", "stream-source") for p in Path(shared_dir(spark).removeprefix("file:")).glob(f"{n}-*/**/*.parquet")}
    before = there()
    assert catalog.q3_released_spans(Tables(spark, "/root/testdata/sf0.001")).count() > 0
    assert there() == before


def test_chunks_of_state_are_compressed():
    rows = pd.DataFrame({"trace_id": [f"{i // 4:032d}" for i in range(1000)], "service_name": ["gateway"] * 1000})
    kept = []

    class State:
        def get(self):
            return iter(kept)

        def appendValue(self, row):
            kept.append(row)

        def clear(self):
            kept.clear()

    traces = pending.PendingTraces(["trace_id"], list(rows.columns), 30, 600)
    traces._replace(State(), rows)
    assert len(kept[0][0]) < len(pickle.dumps(rows)) / 3
    pd.testing.assert_frame_equal(traces._rows(State()), rows)
