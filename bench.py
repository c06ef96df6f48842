"""Headline queries over a stored span table. Prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. The span table is written
first and timed as ``ingest_spans``; the queries then read it, as they would in use.
"""

from __future__ import annotations

import json
import os
import time
from functools import cached_property

from pyspark.sql import DataFrame

from spanloom.plans.catalog import CATALOG
from spanloom.session import build_session, staged
from spanloom.sources.driver_tables import Tables

HEADLINE = [
    "j1_service_metrics",
    "g1_trace_summary",
    "g2_recent_traces",
    "g4_search_traces",
    "g6_error_traces",
    "g7_slow_traces",
    "c13_grouping",
    "d3_service_spans",
    "d7_search_spans",
    "h2_service_edges",
    "h5_service_map",
    "v1_span_depth",
    "v3_self_times",
    "v7_time_histogram",
    "k3_rolling_health",
    "l1_search_documents",
    "f9_tokens",
    "p4_tail_decisions",
    "w5_anomalies",
    "b2_jaeger",
    "q2_metric_windows",
]


class StoredTables(Tables):
    """Tables whose spans have been written once."""

    @cached_property
    def spans(self) -> DataFrame:
        return staged(super().spans, "bench-spans")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = StoredTables(spark, sf_dir)

    # Starting the JVM and its first job are not part of any query.
    Tables(spark, sf_dir).spans.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    begun = time.perf_counter()
    spans = tables.spans.count()
    times["ingest_spans"] = time.perf_counter() - begun
    for name in HEADLINE:
        begun = time.perf_counter()
        CATALOG[name](tables).write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - begun
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "spans": spans,
                "ingest_spans_per_sec": round(spans / times["ingest_spans"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
