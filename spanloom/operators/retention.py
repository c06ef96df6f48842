"""Table maintenance X1-X6. Each step returns the rows that stay."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.operators.ranked import ranked
from spanloom.session import staged

RETENTION_NS = S.NS_PER_HOUR
INCOMPLETE_AFTER_NS = 5 * S.NS_PER_MIN
IDLE_AFTER_NS = 15 * S.NS_PER_MIN


def expire(
    spans: DataFrame, as_of_ns: int, retention_ns: int = RETENTION_NS, day_column: str | None = None
) -> DataFrame:
    """Drop spans that started before the retention period.

    ``day_column`` names the ``yyyyMMdd`` partition column of the table, if it has one: older days
    are then not read at all.
    """
    oldest = as_of_ns - retention_ns
    if day_column is not None:
        first_day = datetime.fromtimestamp(oldest // S.NS_PER_SEC, timezone.utc).strftime("%Y%m%d")
        spans = spans.filter(F.col(day_column).cast("string") >= first_day)
    return spans.filter(F.col("start_ns") >= oldest)


def incomplete_traces(spans: DataFrame, as_of_ns: int, after_ns: int = INCOMPLETE_AFTER_NS) -> DataFrame:
    """Ids of traces with a single, old span."""
    return (
        spans.groupBy("trace_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("start_ns").alias("last_ns"))
        .filter((F.col("n") == 1) & (F.col("last_ns") < as_of_ns - after_ns))
        .select("trace_id")
    )


def drop_incomplete(spans: DataFrame, as_of_ns: int, after_ns: int = INCOMPLETE_AFTER_NS) -> DataFrame:
    """X2. The ids are written first, so that their true number picks the join."""
    incomplete = staged(incomplete_traces(spans, as_of_ns, after_ns), "incomplete")
    return spans.join(incomplete, "trace_id", "left_anti")


def idle_services(spans: DataFrame, as_of_ns: int, after_ns: int = IDLE_AFTER_NS) -> DataFrame:
    """Services without a span for a while."""
    return (
        spans.groupBy("service_name")
        .agg(F.max("start_ns").alias("last_ns"))
        .filter(F.col("last_ns") <= as_of_ns - after_ns)
        .select("service_name")
    )


def drop_idle(spans: DataFrame, as_of_ns: int, after_ns: int = IDLE_AFTER_NS) -> DataFrame:
    """X3. The services are written first: few of them are broadcast, and no span is moved."""
    idle = staged(idle_services(spans, as_of_ns, after_ns), "idle")
    return spans.join(idle, "service_name", "left_anti")


def keep_newest(spans: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest spans; spans of the same start are taken by id.

    The start time at the cut is found as an exact rank, without sorting the table; only spans that
    start at that very moment are then ordered to fill what is left.
    """
    # The newest n rows are those of descending index 0..n-1.
    cut = Q.rank_quantiles(
        spans.select("start_ns"),
        [],
        "start_ns",
        {"cut_ns": lambda rows: F.greatest(rows - n, F.lit(0).cast("bigint"))},
        buckets=Q.time_buckets("start_ns"),
    ).scalar()
    newer = spans.filter(F.col("start_ns") > cut)
    at_cut = spans.filter(F.col("start_ns") == cut)
    room = F.lit(n) - newer.agg(F.count(F.lit(1))).scalar()
    filled = ranked(at_cut, [], ["trace_id", "span_id"]).filter(F.col("row_number") <= room)
    return newer.unionByName(filled.select(*spans.columns))


def evict(spans: DataFrame, rows: int, capacity: int, warning: float = 0.7) -> DataFrame:
    """Over capacity the oldest fifth goes, above the warning level the oldest twentieth."""
    if rows >= capacity:
        return keep_newest(spans, rows - rows // 5)
    if rows >= capacity * warning:
        return keep_newest(spans, rows - rows // 20)
    return spans


def maintain(
    spans: DataFrame,
    as_of_ns: int,
    max_spans: int,
    retention_ns: int = RETENTION_NS,
    idle_after_ns: int = IDLE_AFTER_NS,
) -> DataFrame:
    """Expire, drop incomplete, drop idle, cap - in this order, each step on a written table."""
    kept = staged(expire(spans, as_of_ns, retention_ns), "maintain")
    kept = staged(drop_incomplete(kept, as_of_ns), "maintain")
    kept = staged(drop_idle(kept, as_of_ns, idle_after_ns), "maintain")
    return keep_newest(kept, max_spans)
