"""Lookups D1-D9 and trace level aggregates G1-G9, with the sorts and limits O1-O5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.session import staged

MAX_RESULTS = 1_000
DEFAULT_RESULTS = 100


def checked_limit(limit: int | None, default: int = DEFAULT_RESULTS, most: int = MAX_RESULTS) -> int:
    """A limit for the interactive lists, which state it; one out of bounds is an error."""
    limit = default if limit is None else limit
    if not 0 < limit <= most:
        raise ValueError(f"limit must be between 1 and {most}, not {limit}")
    return limit


# Lookups ----------------------------------------------------------------------------------------
def span_by_id(spans: DataFrame, span_id: str) -> DataFrame:
    """D1."""
    return spans.filter(F.col("span_id") == span_id)


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of a trace by start."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_ns", "span_id")


def service_spans(spans: DataFrame, service: str, since_ns: int) -> DataFrame:
    """D3."""
    return spans.filter((F.col("service_name") == service) & (F.col("start_ns") >= since_ns))


def active_services(spans: DataFrame) -> DataFrame:
    """D4."""
    return spans.groupBy("service_name").agg(F.max("start_ns").alias("last_seen_ns"))


def span_count(spans: DataFrame) -> DataFrame:
    """D5."""
    return spans.agg(F.count(F.lit(1)).alias("span_count"))


def spans_of_services(spans: DataFrame, services: Sequence[str]) -> DataFrame:
    """Spans of several services in one scan."""
    return spans.filter(F.col("service_name").isin(list(services)))


def text_match(query: str, attribute_key: str | None = None) -> Column:
    """Case-insensitive substring of the operation, an attribute key or an attribute value.

    ``attribute_key`` narrows the attribute part to one key, not the operation part.
    """
    q = query.lower()
    attributes = F.col("attributes")
    if attribute_key is None:
        in_attributes = F.exists(
            F.map_entries(attributes), lambda e: F.lower(e["key"]).contains(q) | F.lower(e["value"]).contains(q)
        )
    else:
        value = attributes[attribute_key]
        in_attributes = value.isNotNull() & (F.lit(q in attribute_key.lower()) | F.lower(value).contains(q))
    return F.lower("operation_name").contains(q) | F.coalesce(in_attributes, F.lit(False))


def search_spans(
    spans: DataFrame,
    query: str,
    service: str | None = None,
    attribute_key: str | None = None,
    limit: int = DEFAULT_RESULTS,
) -> DataFrame:
    """Newest matching spans."""
    found = spans.filter(text_match(query, attribute_key))
    if service is not None:
        found = found.filter(F.col("service_name") == service)
    return found.orderBy(F.desc("start_ns"), "trace_id", "span_id").limit(limit)


def child_spans(spans: DataFrame, trace_id: str, span_id: str) -> DataFrame:
    """Direct children of a span."""
    return spans.filter((F.col("trace_id") == trace_id) & (F.col("parent_span_id") == span_id))


def service_spans_in_trace(spans: DataFrame, trace_id: str, service: str) -> DataFrame:
    """Spans of one service inside one trace."""
    return spans.filter((F.col("trace_id") == trace_id) & (F.col("service_name") == service))


def root_spans(spans: DataFrame) -> DataFrame:
    """The first parentless span of every trace."""
    columns = [c for c in spans.columns if c != "trace_id"]
    first = F.min_by(F.struct(*columns), F.struct("start_ns", "span_id"))
    return spans.filter(S.is_root()).groupBy("trace_id").agg(first.alias("_root")).select("trace_id", "_root.*")


def services_of_traces(spans: DataFrame) -> DataFrame:
    """The distinct services of every trace, sorted by name."""
    return spans.groupBy("trace_id").agg(F.sort_array(F.collect_set("service_name")).alias("services"))


def store_statistics(
    spans: DataFrame, budget_bytes: int, warning: float = 0.7, critical: float = 0.85
) -> DataFrame:
    """Counts, time range, size estimate and the health class of the fill level."""
    stats = spans.agg(
        F.count(F.lit(1)).alias("span_count"),
        F.approx_count_distinct("trace_id", 0.01).alias("trace_count_estimate"),
        F.approx_count_distinct("service_name", 0.01).alias("service_count_estimate"),
        F.min("start_ns").alias("oldest_ns"),
        F.max("start_ns").alias("newest_ns"),
        F.sum(S.span_bytes()).alias("bytes"),
        F.count_if(S.is_error()).alias("error_count"),
    )
    pressure = F.col("bytes") / F.lit(float(budget_bytes))
    return stats.select(
        "*",
        (F.col("error_count") / F.col("span_count")).alias("error_rate"),
        pressure.alias("pressure"),
        F.when(pressure >= critical, "critical").when(pressure >= warning, "degraded").otherwise("healthy").alias("health"),
    )


def exact_counts(spans: DataFrame) -> DataFrame:
    """Exact numbers of spans, traces and services.

    Traces are counted in two steps, so that ids meet only their own kind and no set is built.
    """
    by_trace = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    services = spans.select("service_name").distinct().agg(F.count(F.lit(1))).scalar()
    return by_trace.agg(
        F.sum("n").alias("span_count"), F.count(F.lit(1)).alias("trace_count"), F.max(services).alias("service_count")
    )


# Trace level aggregates ---------------------------------------------------------------------------
def trace_summary(spans: DataFrame, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per trace; ``measures`` are further aggregates of its spans.

    ``duration_ns`` is the extent from first start to last end, ``max_span_duration_ns`` the longest
    single span. The root is the first parentless span, or the first span when there is none.
    Every aggregate combines on the map side, so a trace of any size arrives as a few rows.
    """
    first = F.min(
        F.struct(
            F.when(S.is_root(), 0).otherwise(1).alias("later_if_child"),
            "start_ns",
            "span_id",
            "service_name",
            "operation_name",
        )
    )
    grouped = spans.groupBy("trace_id").agg(
        first.alias("_first"),
        F.count(F.lit(1)).alias("span_count"),
        F.min("start_ns").alias("start_ns"),
        F.max(S.span_end_ns()).alias("end_ns"),
        F.max("duration_ns").alias("max_span_duration_ns"),
        F.count_if(S.is_error()).alias("error_count"),
        F.collect_set("service_name").alias("services"),
        *[c.alias(n) for n, c in (measures or {}).items()],
    )
    return grouped.select(
        "trace_id",
        F.col("_first.service_name").alias("root_service"),
        F.col("_first.operation_name").alias("root_operation"),
        F.col("_first.span_id").alias("root_span_id"),
        (F.col("_first.later_if_child") == 0).alias("has_root"),
        "span_count",
        "start_ns",
        "end_ns",
        (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
        "max_span_duration_ns",
        "error_count",
        (F.col("error_count") > 0).alias("has_error"),
        F.array_sort("services").alias("services"),
        F.size("services").cast("bigint").alias("service_count"),
        *(measures or {}),
    )


def summary_columns(summary: DataFrame, search: bool = False) -> DataFrame:
    """The public trace row. ``search`` gives the search contract: longest span, root or unknown."""
    if search:
        duration = F.col("max_span_duration_ns").alias("duration_ns")
        root = [
            F.when(F.col("has_root"), F.col(c)).otherwise("unknown").alias(c)
            for c in ("root_service", "root_operation")
        ]
    else:
        duration = F.col("duration_ns")
        root = [F.col("root_service"), F.col("root_operation")]
    return summary.select("trace_id", *root, "span_count", duration, "start_ns", "has_error", "services")


def _newest_first() -> list[Column]:
    return [F.desc("start_ns"), F.col("trace_id")]


def _top_ids(
    spans: DataFrame,
    limit: int,
    measures: dict[str, Column] | None = None,
    having: Column | None = None,
) -> DataFrame:
    """Ids of the newest traces that pass ``having``; shuffles ids and numbers only."""
    measures = measures or {}
    ids = spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), *[c.alias(n) for n, c in measures.items()]
    )
    if having is not None:
        ids = ids.filter(having)
    return ids.orderBy(*_newest_first()).limit(limit)


def only_traces(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """Spans of the given traces. The ids are written, so their true size picks the join."""
    return spans.join(staged(ids.select("trace_id"), "trace-ids"), "trace_id", "left_semi")


def _describe(spans: DataFrame, ids: DataFrame, search: bool) -> DataFrame:
    return summary_columns(trace_summary(only_traces(spans, ids)), search).orderBy(*_newest_first())


def _with_hits(spans: DataFrame, test: Column) -> DataFrame:
    """Spans of the traces in which some span passes the test, which thereby reaches the scan."""
    return only_traces(spans, spans.filter(test).select("trace_id").distinct())


def recent_traces(spans: DataFrame, limit: int = DEFAULT_RESULTS, service: str | None = None) -> DataFrame:
    """Newest traces, optionally those that touch a service."""
    if service is None:
        ids = _top_ids(spans, limit)
    else:
        ids = _top_ids(_with_hits(spans, F.col("service_name") == service), limit)
    return _describe(spans, ids, search=False)


def search_traces(
    spans: DataFrame,
    query: str,
    limit: int = DEFAULT_RESULTS,
    service: str | None = None,
    errors_only: bool = False,
    since_ns: int | None = None,
) -> DataFrame:
    """Newest traces in which some span matches the text."""
    measures, having = {}, F.lit(True)
    if service is not None:
        measures["touches"] = F.bool_or(F.col("service_name") == service)
        having = having & F.col("touches")
    if errors_only:
        measures["failed"] = F.bool_or(S.is_error())
        having = having & F.col("failed")
    if since_ns is not None:
        having = having & (F.col("start_ns") >= since_ns)
    # A trace that starts late enough has no earlier span, so older hits can't be of use.
    hit = text_match(query) if since_ns is None else text_match(query) & (F.col("start_ns") >= since_ns)
    found = _with_hits(spans, hit)
    # The ids are of traces with a hit, so describing needs no look at the hits again.
    return _describe(spans, _top_ids(found, limit, measures, having), search=True)


def _every_span(service: str | None, start_ns: int | None, end_ns: int | None, service_match: str):
    measures, having = {}, F.lit(True)
    if service is not None:
        fold = F.bool_and if service_match == "all" else F.bool_or
        measures["right_service"] = fold(F.col("service_name") == service)
        having = having & F.col("right_service")
    if start_ns is not None:
        having = having & (F.col("start_ns") >= start_ns)
    if end_ns is not None:
        measures["latest_ns"] = F.max("start_ns")
        having = having & (F.col("latest_ns") <= end_ns)
    return measures, having


def list_trace_ids(
    spans: DataFrame,
    service: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    limit: int = MAX_RESULTS,
    service_match: str = "all",
) -> DataFrame:
    """The ids behind :func:`list_traces`."""
    measures, having = _every_span(service, start_ns, end_ns, service_match)
    return _top_ids(spans, limit, measures, having)


def list_traces(
    spans: DataFrame,
    service: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    limit: int = MAX_RESULTS,
    service_match: str = "all",
) -> DataFrame:
    """Newest traces all of whose spans are of the service and within the bounds (inclusive).

    ``service_match='any'`` asks only for one span of the service.
    """
    ids = list_trace_ids(spans, service, start_ns, end_ns, limit, service_match)
    return _describe(spans, ids, search=True)


def error_traces(spans: DataFrame, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """Newest traces with an error."""
    failed = _with_hits(spans, S.is_error())
    return _describe(spans, _top_ids(failed, limit), search=True)


def slow_traces(
    spans: DataFrame,
    threshold_ns: int,
    limit: int = DEFAULT_RESULTS,
    candidates: int | None = None,
) -> DataFrame:
    """Traces whose extent reaches the threshold, longest span first.

    The longest are picked among all slow traces, or among the newest ``candidates`` of them.
    """
    slow = (
        spans.groupBy("trace_id")
        .agg(
            F.min("start_ns").alias("start_ns"),
            F.max(S.span_end_ns()).alias("end_ns"),
            F.max("duration_ns").alias("duration_ns"),
        )
        .filter(F.col("end_ns") - F.col("start_ns") >= threshold_ns)
    )
    if candidates is not None:
        slow = slow.orderBy(*_newest_first()).limit(candidates)
    longest = [F.desc("duration_ns"), F.desc("start_ns"), F.col("trace_id")]
    ids = slow.orderBy(*longest).limit(limit)
    return summary_columns(trace_summary(only_traces(spans, ids)), search=True).orderBy(*longest)


def trace_features(spans: DataFrame) -> DataFrame:
    """What sampling decides on. ``duration_ms`` is the extent, as in P7."""
    grouped = spans.groupBy("trace_id").agg(
        F.bool_or(S.is_error()).alias("has_error"),
        F.min("start_ns").alias("start_ns"),
        F.max(S.span_end_ns()).alias("end_ns"),
        F.max("duration_ns").alias("max_span_duration_ns"),
        F.count(F.lit(1)).alias("span_count"),
        F.size(F.collect_set("service_name")).cast("bigint").alias("service_count"),
    )
    return grouped.withColumn("duration_ms", S.div(F.col("end_ns") - F.col("start_ns"), S.NS_PER_MS)).drop("end_ns")


def dashboard(summary: DataFrame) -> DataFrame:
    """Totals over traces, one row. P95 counts down from the longest trace, in ms."""
    timed = summary.select(
        S.div("duration_ns", S.NS_PER_MS).alias("duration_ms"), "has_error", "span_count"
    )
    stats = Q.rank_quantiles(
        timed,
        [],
        "duration_ms",
        {"p95_ms": Q.descending_index(0.05)},
        carry={
            "traces": (F.count(F.lit(1)), F.sum),
            "errors": (F.count_if("has_error"), F.sum),
            "total_ms": (F.sum(F.col("duration_ms").cast("decimal(19,0)")), F.sum),
            "spans": (F.sum("span_count"), F.sum),
        },
        buckets=Q.bit_buckets("duration_ms", 10),
    )
    return stats.select(
        "traces",
        "errors",
        (F.col("errors") * 100 / F.col("traces")).alias("error_percent"),
        (F.col("total_ms").cast("double") / F.col("traces")).alias("avg_ms"),
        (F.col("spans") / F.col("traces")).alias("spans_per_trace"),
        "p95_ms",
    )


def flow_rows(summary: DataFrame, service: str | None = None, verdict: str | None = None) -> DataFrame:
    """V8: one flow per trace; the destination is the second of its services by name."""
    rows = summary.select(
        "trace_id",
        "start_ns",
        F.col("root_service").alias("source"),
        F.coalesce(F.get("services", F.lit(1)), F.lit("unknown")).alias("destination"),
        F.col("root_operation").alias("path"),
        F.when(F.col("has_error"), 500).otherwise(200).alias("status_code"),
        F.col("duration_ns").alias("latency_ns"),
        F.when(F.col("has_error"), "ERROR").otherwise("FORWARDED").alias("verdict"),
    )
    if service is not None:
        rows = rows.filter(F.col("source").contains(service) | F.col("destination").contains(service))
    if verdict is not None:
        rows = rows.filter(F.col("verdict") == verdict)
    return rows
