"""Service level operators J1-J18."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.operators.ranked import ranked

WINDOW_SECONDS = 60

_BIG = "decimal(19,0)"


def service_metrics(spans: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Counts, rates, exact rank percentiles and duration statistics per service, in ns."""
    stats = Q.rank_quantiles(
        spans.select("service_name", "duration_ns", "start_ns", S.is_error().alias("failed")),
        ["service_name"],
        "duration_ns",
        {
            "p50_ns": Q.percent_index(50),
            "p95_ns": Q.percent_index(95),
            "p99_ns": Q.percent_index(99),
        },
        carry={
            "span_count": (F.count(F.lit(1)), F.sum),
            "error_count": (F.count_if("failed"), F.sum),
            "total_ns": (F.sum(F.col("duration_ns").cast(_BIG)), F.sum),
            "min_ns": (F.min("duration_ns"), F.min),
            "max_ns": (F.max("duration_ns"), F.max),
            "last_seen_ns": (F.max("start_ns"), F.max),
        },
    )
    return stats.select(
        "service_name",
        "span_count",
        "error_count",
        (F.col("error_count") / F.col("span_count")).alias("error_rate"),
        (F.col("span_count") / F.lit(float(window_seconds))).alias("request_rate"),
        "p50_ns",
        "p95_ns",
        "p99_ns",
        F.call_function("div", F.col("total_ns"), F.col("span_count").cast(_BIG)).alias("avg_ns"),
        "min_ns",
        "max_ns",
        "last_seen_ns",
    )


def services_in_order(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metrics of the named services in the order asked for; no names means all services."""
    if not names:
        return metrics.withColumn("pos", F.lit(None).cast("int"))
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("service_name"))
    return (
        metrics.filter(F.col("service_name").isin(list(names)))
        .withColumn("pos", (position - 1).cast("int"))
        .orderBy("pos")
    )


def active_spans() -> Column:
    """Request rate times median seconds, rounded down."""
    return F.floor(F.col("request_rate") * (F.col("p50_ns") / F.lit(float(S.NS_PER_SEC)))).cast("bigint")


def service_list(metrics: DataFrame) -> DataFrame:
    """Counts and percentiles in microseconds."""
    return metrics.select(
        "service_name",
        "span_count",
        "error_count",
        "error_rate",
        *[S.div(f"{p}_ns", S.NS_PER_US).alias(f"{p}_us") for p in ("p50", "p95", "p99")],
    )


def running_metrics(spans: DataFrame) -> DataFrame:
    """Mergeable running totals per service; valid on batch and streaming input."""
    return spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(S.is_error()).alias("error_count"),
        F.sum(F.col("duration_ns").cast(_BIG)).alias("total_ns"),
        F.min("duration_ns").alias("min_ns"),
        F.max("duration_ns").alias("max_ns"),
        F.max("start_ns").alias("last_seen_ns"),
    )


def running_rates(running: DataFrame) -> DataFrame:
    """Error rate and mean from the running totals."""
    return running.select(
        "service_name",
        "span_count",
        "error_count",
        (F.col("error_count") / F.col("span_count")).alias("error_rate"),
        (F.col("total_ns").cast("double") / F.col("span_count")).alias("mean_ns"),
        "min_ns",
        "max_ns",
        "last_seen_ns",
    )


# Fixed value: error rate below which a service is healthy.
HEALTHY_BELOW = 0.05


def health_flags(metrics: DataFrame) -> DataFrame:
    """J10."""
    return metrics.withColumns(
        {
            "is_healthy": F.col("error_rate") < HEALTHY_BELOW,
            "success_rate": F.lit(1.0) - F.col("error_rate"),
        }
    )


def health_class(value: Column | str, warning: float, critical: float, strict: bool = False) -> Column:
    """``healthy`` / ``warning`` / ``critical``. ``strict`` asks for more than the bound."""
    value = F.col(value) if isinstance(value, str) else value
    over = (lambda bound: value > bound) if strict else (lambda bound: value >= bound)
    return (
        F.when(over(critical), F.lit("critical")).when(over(warning), F.lit("warning")).otherwise("healthy")
    )


def health_scales(metrics: DataFrame) -> DataFrame:
    """Every scale in use, side by side. Bounds are fixed values."""
    percent = F.col("error_rate") * 100
    p99_ms = F.col("p99_ns") / F.lit(float(S.NS_PER_MS))
    return metrics.select(
        "service_name",
        health_class("error_rate", 0.01, 0.05).alias("by_fraction"),
        F.when(percent == 0, "healthy").when(percent < 1, "warning").otherwise("critical").alias("by_percent"),
        health_class(percent, 1.0, 5.0, strict=True).alias("by_graph_percent"),
        health_class("error_rate", 0.01, 0.1, strict=True).alias("by_node"),
        health_class(p99_ms, 100.0, 500.0).alias("by_p99"),
    )


def health_counts(classes: DataFrame, column: str = "by_fraction") -> DataFrame:
    return classes.groupBy(F.col(column).alias("health")).agg(F.count(F.lit(1)).alias("services"))


def fleet_summary(metrics: DataFrame) -> DataFrame:
    """Totals over all services, one row."""
    return metrics.agg(
        F.count(F.lit(1)).alias("services"),
        F.sum("request_rate").alias("total_rps"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.max("p99_ns").alias("max_p99_ns"),
    )


def busiest_services(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("request_rate"), "service_name")


# Name parts that tell a service type, first match wins.
SERVICE_TYPES = [
    ("database", ["db", "postgres", "mysql"]),
    ("cache", ["redis", "cache"]),
    ("external", ["api", "external"]),
]


def service_type(name: Column | str = "service_name") -> Column:
    """J13."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit("service")
    for kind, parts in reversed(SERVICE_TYPES):
        out = F.when(name.rlike("|".join(parts)), F.lit(kind)).otherwise(out)
    return out


def partial_aggregates(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sum, count, min and max of the values that are numbers."""
    number = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(
        F.sum(number).alias("sum"),
        F.count(number).alias("count"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )


def merge_aggregates(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial rows, and the mean of the merged group."""
    merged = partials.groupBy(*keys).agg(
        F.sum("sum").alias("sum"),
        F.sum("count").alias("count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(F.lit(0.0))
    return merged.withColumn("avg", mean)


def alerts(
    metrics: DataFrame,
    error_percent: float = 5.0,
    p95_ns: int = S.NS_PER_SEC,
    min_samples: int = 100,
) -> DataFrame:
    """Services with enough samples that break a threshold."""
    too_many = F.col("error_rate") * 100 > error_percent
    too_slow = F.col("p95_ns") > p95_ns
    return metrics.filter((F.col("span_count") >= min_samples) & (too_many | too_slow)).withColumns(
        {"error_alert": too_many, "latency_alert": too_slow}
    )


# Severity points of the health score.
CRITICAL_POINTS, UNHEALTHY_POINTS, RESOURCE_WARNING_POINTS, WARNING_POINTS = 100, 75, 50, 25


def system_health(
    hosts: DataFrame,
    memory_warning_mb: float = 400,
    memory_critical_mb: float = 480,
    cpu_warning_percent: float = 70,
    cpu_critical_percent: float = 90,
) -> DataFrame:
    """Health class of rows with ``memory_mb, cpu_percent, error_rate, query_latency_ms``."""

    def points(name: str, warning: float, critical: float, low: int, high: int) -> Column:
        value = F.col(name)
        return F.when(value > critical, high).when(value > warning, low).otherwise(0)

    score = F.greatest(
        points("memory_mb", memory_warning_mb, memory_critical_mb, RESOURCE_WARNING_POINTS, CRITICAL_POINTS),
        points("cpu_percent", cpu_warning_percent, cpu_critical_percent, RESOURCE_WARNING_POINTS, CRITICAL_POINTS),
        points("error_rate", 0.05, 0.1, WARNING_POINTS, UNHEALTHY_POINTS),
        points("query_latency_ms", 50.0, 100.0, WARNING_POINTS, UNHEALTHY_POINTS),
    )
    return hosts.withColumn("severity", score).withColumn(
        "health",
        F.when(F.col("severity") <= 10, "healthy")
        .when(F.col("severity") <= 40, "degraded")
        .when(F.col("severity") <= 80, "unhealthy")
        .otherwise("critical"),
    )


def error_statistics(errors: DataFrame, by: str, elapsed_seconds: float) -> DataFrame:
    """Error counts and rate per second by ``category`` or ``operation``."""
    return (
        errors.filter(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("name"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .withColumn("errors_per_second", F.col("errors") / F.lit(float(elapsed_seconds)))
    )


def newest_errors(errors: DataFrame, limit: int = 100, order: Sequence[str] = ("ts_ns", "event_id")) -> DataFrame:
    """The newest errors."""
    return errors.orderBy(*[F.desc(c) for c in order]).limit(limit)


def latency_ema(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.1
) -> DataFrame:
    """Exponential moving average per key, seeded by its first value.

    The fold has a closed form: the value ``k`` steps before the last weighs
    ``alpha * (1 - alpha)**k``, and the seed weighs ``(1 - alpha)**(n - 1)``. With distributed row
    numbers it is a plain weighted sum, so a key of any size is spread over all tasks.
    """
    numbered = ranked(df.select(*keys, *order, F.col(value).cast("double").alias("_v")), keys, order)
    back = (F.col("group_rows") - F.col("row_number")).cast("double")
    weight = F.pow(F.lit(1.0 - alpha), back) * F.when(F.col("row_number") == 1, 1.0).otherwise(alpha)
    return numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("_v") * weight).alias("ema")
    )
