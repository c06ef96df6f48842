"""Joins and the service graph H1-H12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.operators.ranked import look_back
from spanloom.operators.traces import list_trace_ids, only_traces
from spanloom.session import staged

# 2**13 us is 8 ms, the same width as the default bucket for nanoseconds.
_US_BUCKET_BITS = 13


def parent_child(spans: DataFrame) -> DataFrame:
    """H1: child spans with the service of their parent in the same trace.

    The join key is (trace, span), so a large trace is spread over many partitions; only children
    of one span share a key, and adaptive execution splits that side.
    """
    parents = spans.select(
        "trace_id",
        F.col("span_id").alias("parent_span_id"),
        F.col("service_name").alias("parent_service"),
    )
    return spans.filter(F.col("parent_span_id").isNotNull()).join(parents, ["trace_id", "parent_span_id"])


def cross_service_calls(spans: DataFrame) -> DataFrame:
    """Calls from one service to another: one row per child span."""
    slim = spans.select(
        "trace_id", "span_id", "parent_span_id", "service_name", "operation_name", "duration_ns", "status"
    )
    return (
        parent_child(slim)
        .filter(F.col("parent_service") != F.col("service_name"))
        .select(
            F.col("parent_service").alias("from"),
            F.col("service_name").alias("to"),
            S.div("duration_ns", S.NS_PER_US).alias("latency_us"),
            S.is_error().alias("failed"),
            F.col("operation_name").alias("operation"),
        )
    )


def service_edges(calls: DataFrame) -> DataFrame:
    """H2: one row per (from, to) with counts, mean and p99 latency in us, and the operations.

    ``calls`` is read three times; pass a written table (see :func:`staged_calls`).
    """
    stats = Q.rank_quantiles(
        calls,
        ["from", "to"],
        "latency_us",
        {"p99_latency_us": Q.scaled_index(0.99)},
        carry={
            "call_count": (F.count(F.lit(1)), F.sum),
            "error_count": (F.count_if("failed"), F.sum),
            "total_us": (F.sum(F.col("latency_us").cast("decimal(19,0)")), F.sum),
        },
        buckets=Q.bit_buckets("latency_us", _US_BUCKET_BITS),
    )
    operations = calls.groupBy("from", "to").agg(F.sort_array(F.collect_set("operation")).alias("operations"))
    return stats.join(operations, ["from", "to"]).select(
        "from",
        "to",
        "call_count",
        "error_count",
        F.call_function("div", F.col("total_us"), F.col("call_count").cast("decimal(19,0)")).alias("avg_latency_us"),
        "p99_latency_us",
        "operations",
    )


def staged_calls(spans: DataFrame) -> DataFrame:
    """The cross-service calls as a written table, so the self-join runs once."""
    return staged(cross_service_calls(spans), "calls")


def service_nodes(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """H3: one row per service; roots are never called, leaves never call."""
    called = edges.select(F.col("to").alias("service_name")).distinct().withColumn("_in", F.lit(True))
    calling = edges.select(F.col("from").alias("service_name")).distinct().withColumn("_out", F.lit(True))
    stats = spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(S.is_error()).alias("errors"),
        F.sum(S.div("duration_ns", S.NS_PER_US).cast("decimal(19,0)")).alias("total_us"),
    )
    return (
        stats.join(called, "service_name", "left")
        .join(calling, "service_name", "left")
        .select(
            "service_name",
            "request_count",
            (F.col("errors") / F.col("request_count")).alias("error_rate"),
            F.call_function("div", F.col("total_us"), F.col("request_count").cast("decimal(19,0)")).alias(
                "avg_latency_us"
            ),
            F.col("_in").isNull().alias("is_root"),
            F.col("_out").isNull().alias("is_leaf"),
        )
    )


def service_tiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H4: distance of every service from the nearest root.

    Services no root reaches get the depth at which the walk ran out, or 0 when there is no root.
    Works on the graph of services, one join per level.
    """
    links = staged(edges.select(F.col("from"), F.col("to")).distinct(), "links")
    services = staged(nodes.select("service_name", "is_root"), "services")
    frontier = services.filter("is_root").select("service_name")
    levels = [frontier.withColumn("tier", F.lit(0))]
    seen = frontier
    while True:
        reached = (
            links.join(frontier, links["from"] == frontier["service_name"], "left_semi")
            .select(F.col("to").alias("service_name"))
            .distinct()
            .join(seen, "service_name", "left_anti")
        )
        frontier = staged(reached, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("tier", F.lit(len(levels))))
        seen = seen.unionByName(frontier)
    tiers = levels[0]
    for level in levels[1:]:
        tiers = tiers.unionByName(level)
    beyond = F.when(services.agg(F.bool_or("is_root")).scalar(), F.lit(len(levels))).otherwise(0)
    return services.join(tiers, "service_name", "left").select(
        "service_name", F.coalesce("tier", beyond).alias("tier")
    )


def service_map(
    spans: DataFrame,
    trace_limit: int = 1_000,
    window_start_ns: int | None = None,
    window_end_ns: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes with tiers and edges over the newest traces, optionally of a time window."""
    ids = list_trace_ids(spans, None, window_start_ns, window_end_ns, trace_limit)
    chosen = staged(only_traces(spans.drop("attributes", "tags", "resource_attributes"), ids), "map-spans")
    edges = staged(service_edges(staged_calls(chosen)), "edges")
    nodes = service_nodes(chosen, edges)
    nodes = nodes.join(service_tiers(nodes, edges), "service_name").orderBy("tier", "service_name")
    return nodes, edges


# H6: views of the map -----------------------------------------------------------------------------
def focus(edges: DataFrame, service: str) -> DataFrame:
    return edges.filter((F.col("from") == service) | (F.col("to") == service))


def hot_paths(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.orderBy(F.desc("call_count"), "from", "to").limit(limit)


def error_paths(edges: DataFrame) -> DataFrame:
    """Edges with errors, highest error percentage first."""
    percent = F.col("error_count") / F.col("call_count") * 100
    return (
        edges.filter(F.col("error_count") > 0)
        .withColumn("error_percent", percent)
        .orderBy(F.desc("error_percent"), "from", "to")
    )


def tier_groups(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tier").agg(
        F.count(F.lit(1)).alias("services"),
        F.sort_array(F.collect_list("service_name")).alias("names"),
        F.sum("request_count").alias("requests"),
    )


def dependencies(calls: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """H7: edges with their strength, the metrics of the target and its slowest incoming call."""
    slowest = calls.groupBy("to").agg(F.max("latency_us").alias("target_max_latency_us"))
    target = metrics.select(
        F.col("service_name").alias("to"),
        F.col("request_rate").alias("target_request_rate"),
        F.col("error_rate").alias("target_error_rate"),
        F.col("p95_ns").alias("target_p95_ns"),
    )
    strength = F.least(F.col("call_count") / F.lit(100.0), F.lit(1.0))
    return (
        edges.select("from", "to", "call_count", "error_count", strength.alias("strength"))
        .join(target, "to", "left")
        .join(slowest, "to")
    )


def service_paths(spans: DataFrame) -> DataFrame:
    """The services of each trace in the order they first appear, with the trace's totals.

    Spans are reduced to one row per (trace, service) before the list is built.
    """
    visits = spans.groupBy("trace_id", "service_name").agg(
        F.min(F.struct("start_ns", "span_id")).alias("first"),
        F.max(S.span_end_ns()).alias("end_ns"),
        F.bool_or(S.is_error()).alias("failed"),
    )
    return (
        visits.groupBy("trace_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("first", "service_name"))).alias("visits"),
            F.min("first.start_ns").alias("start_ns"),
            F.max("end_ns").alias("end_ns"),
            F.bool_or("failed").alias("has_error"),
        )
        .select(
            "trace_id",
            "start_ns",
            (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
            "has_error",
            F.transform("visits", lambda v: v["service_name"]).alias("path"),
        )
    )


def path_links(paths: DataFrame) -> DataFrame:
    """H8: links between neighbours on the service paths.

    The latency is that of the newest trace on the link divided by its number of services.
    """
    neighbours = F.arrays_zip(
        F.slice("path", F.lit(1), F.size("path") - 1).alias("source"),
        F.slice("path", F.lit(2), F.size("path") - 1).alias("target"),
    )
    links = (
        paths.filter(F.size("path") > 1)
        .select("trace_id", "start_ns", "duration_ns", "has_error", F.size("path").alias("n"), F.explode(neighbours).alias("link"))
        .groupBy(F.col("link.source").alias("source"), F.col("link.target").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if("has_error").alias("errors"),
            F.max_by(F.col("duration_ns") / F.col("n"), F.struct("start_ns", "trace_id")).alias("latency_ns"),
        )
    )
    links = staged(links, "path-links")
    busiest = links.agg(F.max("requests")).scalar()
    return links.withColumn("strength", F.col("requests") / F.greatest(busiest, F.lit(1)) * 10 + 1)


def trace_logs(logs: DataFrame, trace_id: str) -> DataFrame:
    """Logs of one trace, oldest first."""
    return logs.filter(F.col("trace_id") == trace_id).orderBy("ts_ns")


def correlate_logs(logs: DataFrame, summary: DataFrame) -> DataFrame:
    """Logs joined with the trace they name."""
    return logs.filter(F.col("trace_id").isNotNull()).join(
        summary.select(
            "trace_id",
            "root_service",
            "root_operation",
            "has_error",
            F.col("start_ns").alias("trace_start_ns"),
            F.col("duration_ns").alias("trace_duration_ns"),
        ),
        "trace_id",
    )


# Fixed value: spans that start this close together are linked without being parent and child.
FLOW_GAP_NS = 1_000_000


def sequential_flow(spans: DataFrame, gap_ns: int = FLOW_GAP_NS, chunk_rows: int = 20_000) -> DataFrame:
    """Links between consecutive spans of a trace that are related or start close together."""
    slim = spans.select("trace_id", "span_id", "parent_span_id", "start_ns", S.is_error().alias("failed"))
    before = {"before": F.struct("span_id", "start_ns", "failed")}
    paired = look_back(slim, ["trace_id"], ["start_ns", "span_id"], 1, previous=before, chunk_rows=chunk_rows)
    related = F.coalesce(F.col("parent_span_id") == F.col("before.span_id"), F.lit(False))
    close = F.col("start_ns") - F.col("before.start_ns") < gap_ns
    return paired.filter(F.col("before").isNotNull() & (related | close)).select(
        "trace_id",
        F.col("before.span_id").alias("from_span"),
        F.col("span_id").alias("to_span"),
        (F.col("failed") | F.col("before.failed")).alias("failed"),
    )


# Fixed value: a path longer than this is unusual.
MAX_USUAL_PATH = 10


def unusual_path(path: Column | str = "path") -> Column:
    """Too many services, or a service visited again."""
    path = F.col(path) if isinstance(path, str) else path
    return (F.size(path) > MAX_USUAL_PATH) | (F.size(F.array_distinct(path)) < F.size(path))


def call_paths(spans: DataFrame) -> DataFrame:
    """Service sequence along each leaf-to-root call chain, for :func:`unusual_path`."""
    from spanloom.operators.tree import span_tree

    tree = span_tree(spans, labels="service_name", leaves=True)
    return tree.select("trace_id", "span_id", F.split("path", "/").alias("path"))
