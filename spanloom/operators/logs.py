"""Log search, filters and statistics L1-L8."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.operators.intervals import interval_rows, interval_totals
from spanloom.operators.ranked import ranked
from spanloom.session import staged

DEFAULT_LIMIT = 100
_NEWEST = ("ts_ns", "event_id")


def _newest(logs: DataFrame, limit: int, order: Sequence[str] = _NEWEST) -> DataFrame:
    return logs.orderBy(*[F.desc(c) for c in order]).limit(limit)


def has_token(query: str, body: Column | str = "body") -> Column:
    """True when any word of the query is a token of the body.

    A word with a separator in it is never a token. The other words are looked up in the lower-case
    body with separators or the text's ends around them, so no list of tokens is built; the plain
    substring test in front is cheap and rules out most bodies.
    """
    body = F.lower(F.col(body) if isinstance(body, str) else body)
    words = [w for w in S.query_tokens(query) if w.isalnum()]
    if not words:
        return F.lit(False)
    one_of = "|".join(re.escape(w) for w in words)
    bound = r"[^\p{IsAlphabetic}\p{N}]"
    contained = reduce(lambda a, b: a | b, [body.contains(w) for w in words])
    return contained & body.rlike(f"(?:^|{bound})(?:{one_of})(?:{bound}|$)")


def search_logs(logs: DataFrame, query: str, limit: int = DEFAULT_LIMIT, order: Sequence[str] = _NEWEST) -> DataFrame:
    """L1: newest logs with any of the query's words as a token."""
    return _newest(logs.filter(has_token(query)), limit, order)


def token_index(logs: DataFrame, log_id: str = "event_id") -> DataFrame:
    """L1: (token, log id, time) rows, to be written partitioned and sorted by token."""
    return logs.select(F.explode(S.tokens("body")).alias("token"), log_id, "ts_ns")


def _token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_token_index(
    logs: DataFrame, path: str, buckets: int = 256, files_per_bucket: int = 8, log_id: str = "event_id"
) -> None:
    """L1: the token table, foldered by a hash of the token and sorted by token inside files.

    The rows of a folder are spread over several tasks by log id, so a word that is in every log
    does not end up in one task.
    """
    placed = token_index(logs, log_id).withColumns(
        {
            "bucket": _token_bucket(F.col("token"), buckets),
            "_file": F.pmod(F.xxhash64(log_id), F.lit(files_per_bucket)),
        }
    )
    (
        placed.repartition("bucket", "_file")
        .sortWithinPartitions("bucket", "token", "ts_ns")
        .drop("_file")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_token_index(spark: SparkSession, path: str, query: str, buckets: int = 256) -> DataFrame:
    """L1: the folders of a written token table that can hold the query's words."""
    words = S.query_tokens(query)
    if not words:
        return spark.read.parquet(path).limit(0)
    wanted = [_token_bucket(F.lit(w), buckets) for w in words]
    return spark.read.parquet(path).filter(F.col("bucket").isin(*wanted))


def search_index(index: DataFrame, query: str, limit: int = DEFAULT_LIMIT, log_id: str = "event_id") -> DataFrame:
    """L1: newest matching ids from the token table."""
    hits = index.filter(F.col("token").isin(S.query_tokens(query)))
    distinct = hits.groupBy(log_id).agg(F.max("ts_ns").alias("ts_ns"))
    return distinct.orderBy(F.desc("ts_ns"), F.desc(log_id)).limit(limit)


def logs_by_service(logs: DataFrame, service: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """L2."""
    return _newest(logs.filter(F.col("service_name") == service), limit)


def at_least(minimum: str) -> Column:
    """L3: severity at or above the named one; an unknown name lets everything pass."""
    number = S.SEVERITY_NUMBERS.get(minimum.upper())
    return F.lit(True) if number is None else S.severity_number("severity") >= number


def recent_logs(logs: DataFrame, limit: int = DEFAULT_LIMIT, minimum: str | None = None) -> DataFrame:
    """L3, L4: newest logs, optionally of a minimum severity."""
    return _newest(logs if minimum is None else logs.filter(at_least(minimum)), limit)


def severity_counts(logs: DataFrame) -> DataFrame:
    """Logs, bytes and logs with a trace per severity."""
    return logs.groupBy("severity").agg(
        F.count(F.lit(1)).alias("logs"),
        F.sum(S.log_bytes()).alias("bytes"),
        F.count("trace_id").alias("with_trace"),
    )


def distinct_terms(logs: DataFrame) -> DataFrame:
    """Number of distinct tokens; equal tokens are merged before the shuffle."""
    return token_terms(logs).agg(F.count(F.lit(1)).alias("terms"))


def token_terms(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode(S.tokens("body")).alias("token")).distinct()


def log_statistics(logs: DataFrame) -> DataFrame:
    """One row with totals, the view counts and distinct traces."""
    warned = F.col("severity") == "WARN"
    failed = F.col("severity").isin("ERROR", "FATAL")
    traces = logs.select("trace_id").filter(F.col("trace_id").isNotNull()).distinct()
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(failed).alias("errors"),
        F.count_if(warned).alias("warnings"),
        F.count("trace_id").alias("with_trace"),
        F.sum(S.log_bytes()).alias("bytes"),
    ).withColumn("traced_logs", traces.agg(F.count(F.lit(1))).scalar())


def retain_logs(logs: DataFrame, max_logs: int, not_before_ns: int | None = None) -> DataFrame:
    """The newest ``max_logs`` logs, optionally none older than a time; equal times by id.

    The time at the cut is found as an exact rank; only the logs of that very moment are ordered.
    """
    if not_before_ns is not None:
        logs = logs.filter(F.col("ts_ns") >= not_before_ns)
    cut = Q.rank_quantiles(
        logs.select("ts_ns"),
        [],
        "ts_ns",
        {"cut_ns": lambda rows: F.greatest(rows - max_logs, F.lit(0).cast("bigint"))},
        buckets=Q.time_buckets("ts_ns"),
    ).scalar()
    newer = logs.filter(F.col("ts_ns") > cut)
    at_cut = logs.filter(F.col("ts_ns") == cut)
    room = F.lit(max_logs) - newer.agg(F.count(F.lit(1))).scalar()
    size = at_cut.agg(F.count(F.lit(1))).scalar()
    filled = ranked(at_cut, [], ["event_id"]).filter(F.col("row_number") > size - room)
    return newer.unionByName(filled.select(*logs.columns))


def logs_around_traces(logs: DataFrame, summary: DataFrame, slice_ns: int = 60 * S.NS_PER_SEC) -> DataFrame:
    """Logs of a trace's services within its time range.

    The range join becomes an equality join on (service, time slice): a trace is listed in every
    slice it touches, a log in its own, and the exact bounds are checked on the pairs. ``summary``
    holds the traces of interest; written, their true size picks the join.
    """
    first = S.div("start_ns", slice_ns)
    last = S.div("end_ns", slice_ns)
    traces = summary.select(
        "trace_id", "start_ns", "end_ns", F.explode("services").alias("service_name"), F.sequence(first, last).alias("slices")
    ).select("trace_id", "start_ns", "end_ns", "service_name", F.explode("slices").alias("_slice"))
    traces = staged(traces, "trace-slices")
    placed = logs.withColumnRenamed("trace_id", "log_trace_id").withColumn("_slice", S.div("ts_ns", slice_ns))
    return placed.join(traces, ["service_name", "_slice"]).filter(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns"))).drop("_slice")


def _signals(logs: DataFrame, points: DataFrame) -> DataFrame:
    """Log records and metric points in one table: signal, service, time, text, value, failure."""
    of_log = logs.select(
        F.lit("log").alias("signal"), "service_name", "ts_ns", F.col("body").alias("text"), F.lit(None).cast("double").alias("value"),
        F.col("severity").isin("ERROR", "FATAL").alias("failed"),
    )
    of_point = points.select(
        F.lit("metric").alias("signal"), "service_name", "ts_ns", F.col("metric_name").alias("text"), "value", F.lit(False).alias("failed")
    )
    return of_log.unionByName(of_point)


def _reach(summary: DataFrame, margin_ns: int) -> DataFrame:
    """An interval for each trace and service: the trace's extent and a margin around it."""
    return summary.select(
        "trace_id", (F.col("start_ns") - margin_ns).alias("start_ns"), (F.col("end_ns") + margin_ns).alias("end_ns"),
        F.explode("services").alias("service_name"),
    )


def context_rows(summary: DataFrame, logs: DataFrame, points: DataFrame, margin_ns: int = 0) -> DataFrame:
    """The log records and metric points around each trace, of its services and within its time range."""
    found = interval_rows(_signals(logs, points), _reach(summary, margin_ns), ["service_name"], "ts_ns")
    return found.select("trace_id", "signal", "service_name", "ts_ns", "text", "value", "failed")


def trace_context(summary: DataFrame, logs: DataFrame, points: DataFrame, margin_ns: int = 0) -> DataFrame:
    """Every trace with the figures of its context.

    Columns of ``summary`` and log records, failed ones, metric points, the sum of their values, first
    and last moment. No pair of a trace and a record is made. A trace without context has zeros.
    """
    is_log = F.col("signal") == "log"
    measures = {
        "logs": is_log.cast("bigint"),
        "log_errors": F.col("failed").cast("bigint"),
        "points": (~is_log).cast("bigint"),
        "value_sum": F.coalesce("value", F.lit(0.0)),
    }
    totals = interval_totals(_signals(logs, points), _reach(summary, margin_ns), ["service_name"], "ts_ns", measures, ["trace_id"])
    totals = totals.withColumnsRenamed({"first_at": "context_start_ns", "last_at": "context_end_ns"})
    return summary.join(totals, "trace_id", "left").fillna(0, list(measures))


def cross_signal_search(
    spans: DataFrame, logs: DataFrame, points: DataFrame, query: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Newest hits of a text over operations, log tokens and metric names."""
    q = query.lower()
    columns = ["signal", "service_name", "ts_ns", "text"]
    found_spans = spans.filter(F.lower("operation_name").contains(q)).select(
        F.lit("span").alias("signal"), "service_name", F.col("start_ns").alias("ts_ns"), F.col("operation_name").alias("text")
    )
    found_logs = logs.filter(has_token(query)).select(
        F.lit("log").alias("signal"), "service_name", "ts_ns", F.col("body").alias("text")
    )
    found_points = points.filter(F.lower("metric_name").contains(q)).select(
        F.lit("metric").alias("signal"), "service_name", "ts_ns", F.col("metric_name").alias("text")
    )
    hits = found_spans.unionByName(found_logs).unionByName(found_points).select(*columns)
    return hits.orderBy(F.desc("ts_ns"), "signal", "service_name", "text").limit(limit)


def service_overview(spans: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """Per service, how much of each signal there is and how much of it is bad."""
    by_span = spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(S.is_error()).alias("span_errors")
    )
    by_log = logs.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("logs"), F.count_if(F.col("severity").isin("ERROR", "FATAL")).alias("log_errors")
    )
    by_point = points.groupBy("service_name").agg(F.count(F.lit(1)).alias("points"))
    figures = ["spans", "span_errors", "logs", "log_errors", "points"]
    parts = [
        part.select(
            "service_name",
            *[F.col(f) if f in part.columns else F.lit(0).cast("bigint").alias(f) for f in figures],
        )
        for part in (by_span, by_log, by_point)
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("service_name").agg(*[F.sum(f).alias(f) for f in figures])
