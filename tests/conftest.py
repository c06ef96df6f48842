from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from spanloom import schema  # noqa: E402
from spanloom.session import build_session  # noqa: E402

BASE_NS = 1_700_000_000 * 10**9
MS = 10**6


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def span(trace, span_id, parent=None, service="api", operation="op", start_ms=0, ms=100, status="ok", kind="internal", **attributes):
    return (
        trace, span_id, parent, service, operation, BASE_NS + start_ms * MS, ms * MS, kind, status, None,
        {k.replace("__", "."): str(v) for k, v in attributes.items()}, {}, {},
    )


@pytest.fixture(scope="session")
def make_spans(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schema.SPAN)


def built_traces(count, children=3, failing=lambda i: False, root_ms=100):
    """Traces of a root on api-gateway and children on service-{n}, ten seconds apart."""
    rows = []
    for i in range(count):
        trace, root = f"trace_{i:04d}", f"root_{i:04d}"
        at = -10_000 * i
        rows.append(span(trace, root, None, "api-gateway", "request", at, root_ms(i) if callable(root_ms) else root_ms))
        for c in range(children):
            status = "error" if failing(i) and c == 1 else "ok"
            rows.append(span(trace, f"s{i:04d}_{c:02d}", root, f"service-{c}", f"op-{c}", at + 10, 50, status))
    return rows
