"""Metric windows and service health K1-K8, with the rolling window W2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.functions.joins import join_null_safe
from spanloom.session import staged

WINDOW = "1 minute"
PREVIOUS_WINDOWS = 5
MAX_SERVICES = 1_000


def is_latency() -> Column:
    """K1: values above 1000 are latencies; NaN, which Spark orders above all, is none. The bounds are fixed values."""
    return (F.col("value") > 1000.0) & ~F.isnan("value")


def is_metric_error() -> Column:
    """K1: values above 0.5 and up to 1.0 are errors."""
    return (F.col("value") > 0.5) & (F.col("value") <= 1.0)


def classify_points(points: DataFrame) -> DataFrame:
    return points.withColumns({"is_latency": is_latency(), "is_error": is_metric_error()})


def _number() -> Column:
    return F.when(~F.isnan("value"), F.col("value"))


def minute_windows(points: DataFrame, width: str = WINDOW, slide: str | None = None) -> DataFrame:
    """K2: event-time windows per service. Works on batch and streaming input with a ``ts`` column.

    The 95th percentile of a batch is exact; a stream has one pass and estimates it, with rank error 1 / 1000.
    """
    latency = F.when(is_latency(), F.col("value"))
    # NaN is larger than every number in Spark; it must not count as a latency.
    latency = F.when(~F.isnan("value"), latency)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    placed = points.select("service_name", span.alias("window"), "value", latency.alias("_latency"))
    keys = ["service_name", "window"]
    figures = [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_metric_error()).alias("errors"),
        F.count("_latency").alias("latency_count"),
        F.sum("_latency").alias("latency_sum"),
    ]
    if points.isStreaming:
        windows = placed.groupBy(*keys).agg(*figures, Q.approx_percentile("_latency").alias("p95"))
    else:
        p95 = Q.rank_quantiles(placed, keys, "_latency", {"p95": Q.disc_index(0.95)}, buckets=Q.double_buckets("_latency"))
        windows = join_null_safe(placed.groupBy(*keys).agg(*figures), p95, keys, "left")
    return windows.select(
        "service_name",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "requests",
        "errors",
        "latency_count",
        F.coalesce("latency_sum", F.lit(0.0)).alias("latency_sum"),
        F.coalesce("p95", F.lit(0.0)).alias("p95"),
    )


def with_event_time(points: DataFrame) -> DataFrame:
    return points.withColumn("ts", S.ns_to_timestamp("ts_ns"))


def rolling_health(windows: DataFrame, previous: int = PREVIOUS_WINDOWS) -> DataFrame:
    """Health at the end of every window over it and the windows before it that had points.

    A window is one row per service and minute here, so a service contributes its active minutes.
    """
    frame = Window.partitionBy("service_name").orderBy("window_start").rowsBetween(-previous, 0)
    total = F.sum("requests").over(frame)
    latencies = F.sum("latency_count").over(frame)
    elapsed = F.unix_micros("window_end") - F.unix_micros(F.min("window_start").over(frame))
    return windows.select(
        "service_name",
        "window_start",
        "window_end",
        total.alias("requests"),
        (total / F.greatest(elapsed / F.lit(1e6), F.lit(1.0))).alias("request_rate"),
        (F.sum("errors").over(frame) / total * 100).alias("error_rate"),
        F.when(latencies > 0, F.sum("latency_sum").over(frame) / latencies).otherwise(F.lit(0.0)).alias("avg_latency_ms"),
        F.col("p95").alias("p95_latency_ms"),
    )


def current_health(rolling: DataFrame) -> DataFrame:
    """K3, K6: the newest row of every service."""
    columns = [c for c in rolling.columns if c != "service_name"]
    return (
        rolling.groupBy("service_name")
        .agg(F.max_by(F.struct(*columns), "window_start").alias("_now"))
        .select("service_name", "_now.*")
    )


def metric_services(points: DataFrame) -> DataFrame:
    """K5."""
    return points.select("service_name").distinct()


def cap_services(points: DataFrame, order: Sequence[str] = ("ts_ns",), max_services: int = MAX_SERVICES) -> DataFrame:
    """K4: flags the points of services that came after the first ``max_services``."""
    first_seen = points.groupBy("service_name").agg(F.min(F.struct(*order)).alias("_first"))
    admitted = (
        first_seen.orderBy("_first", "service_name").limit(max_services).select("service_name", F.lit(True).alias("_in"))
    )
    # Written, so that its true size picks the join.
    admitted = staged(admitted, "admitted-services")
    return points.join(admitted, "service_name", "left").select(
        *points.columns, F.col("_in").isNull().alias("rejected")
    )


def fleet_averages(health: DataFrame) -> DataFrame:
    """K7: plain averages over services, one row."""
    return health.agg(
        F.avg("request_rate").alias("avg_request_rate"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.avg("avg_latency_ms").alias("avg_latency_ms"),
    )


def time_series(
    points: DataFrame,
    width: str,
    aggregation: str,
    slide: str | None = None,
    metric: str | None = None,
    service: str | None = None,
    percentile: float = 0.95,
) -> DataFrame:
    """K8: a series per service and metric: ``sum``, ``average``, ``rate`` or ``percentile``.

    The rate of a counter is its change over the time between the first and last point of a window.
    """
    if metric is not None:
        points = points.filter(F.col("metric_name") == metric)
    if service is not None:
        points = points.filter(F.col("service_name") == service)
    seconds = (F.max("ts_ns") - F.min("ts_ns")) / F.lit(float(S.NS_PER_SEC))
    order = F.struct("ts_ns", "value")
    change = F.max_by("value", order) - F.min_by("value", order)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    points = points.withColumn("window", span)
    keys = ["service_name", "metric_name", "window"]
    if aggregation == "percentile" and not points.isStreaming:
        found = Q.rank_quantiles(
            points.select(*keys, _number().alias("_number")), keys, "_number", {"value": Q.disc_index(percentile)},
            buckets=Q.double_buckets("_number"),
        )
        series = join_null_safe(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points")), found, keys, "left")
    else:
        figure = {
            "sum": F.sum(_number()),
            "average": F.avg(_number()),
            "rate": F.when(seconds > 0, change / seconds),
            "percentile": Q.approx_percentile(_number(), percentile),
        }[aggregation]
        series = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), figure.alias("value"))
    return series.select("service_name", "metric_name", F.col("window.start").alias("window_start"), "points", "value")


def sample_percentiles(points: DataFrame, ps: dict[str, float]) -> DataFrame:
    """Exact sample percentiles of the values per service."""
    numbers = points.filter(~F.isnan("value"))
    return Q.rank_quantiles(
        numbers,
        ["service_name"],
        "value",
        {name: Q.sample_index(p) for name, p in ps.items()},
        buckets=Q.double_buckets("value"),
    )
