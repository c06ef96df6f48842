"""A kept table of trace summaries, partitioned by day (or month) and merged batch by batch.

A row holds a trace's mergeable state. Its day is that of the first start the store saw of the trace and
never changes, while an earlier span may move the start back. So a trace of an earlier day always
starts before every later day: the newest traces are found by reading days from the newest one back, until
enough of them start within the days read.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators.traces import DEFAULT_RESULTS, MAX_RESULTS, summary_columns
from spanloom.session import staged

#: Rows of a file: a busy day is not one task, and a quiet one is not many files.
ROWS_PER_FILE = 1_000_000
#: Patterns of the partition keys, for Spark and for Python.
_UNITS = {"day": ("yyyyMMdd", "%Y%m%d"), "month": ("yyyyMM", "%Y%m")}
_FIRST = ("later_if_child", "start_ns", "span_id", "service_name", "operation_name")


def trace_states(spans: DataFrame) -> DataFrame:
    """The mergeable state of every trace of ``spans``."""
    first = F.struct(F.when(S.is_root(), 0).otherwise(1).alias("later_if_child"), *_FIRST[1:])
    return spans.groupBy("trace_id").agg(
        F.min(first).alias("first"),
        F.count(F.lit(1)).alias("span_count"),
        F.min("start_ns").alias("start_ns"),
        F.max("start_ns").alias("last_start_ns"),
        F.max(S.span_end_ns()).alias("end_ns"),
        F.max("duration_ns").alias("max_span_duration_ns"),
        F.count_if(S.is_error()).alias("error_count"),
        F.array_sort(F.collect_set("service_name")).alias("services"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per trace from several; their ``dt`` is that of the state which has one."""
    return states.groupBy("trace_id").agg(
        F.min("first").alias("first"),
        F.sum("span_count").alias("span_count"),
        F.min("start_ns").alias("start_ns"),
        F.max("last_start_ns").alias("last_start_ns"),
        F.max("end_ns").alias("end_ns"),
        F.max("max_span_duration_ns").alias("max_span_duration_ns"),
        F.sum("error_count").alias("error_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"),
        F.max("dt").alias("dt"),
    )


def _day(ns: Column, unit: str) -> Column:
    return F.date_format(S.ns_to_timestamp(ns), _UNITS[unit][0])


def _day_of(ns: int, unit: str, shift: int = 0) -> str:
    at = datetime.fromtimestamp(ns // S.NS_PER_SEC, timezone.utc) + timedelta(days=shift)
    return at.strftime(_UNITS[unit][1])


def _unit_of(day: str) -> str:
    return "month" if len(day) == 6 else "day"


def _day_start_ns(day: str) -> int:
    at = datetime.strptime(day, _UNITS[_unit_of(day)][1]).replace(tzinfo=timezone.utc)
    return int(at.timestamp()) * S.NS_PER_SEC


def _exists(spark: SparkSession, pattern: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, f"{path}/dt=*"):
        return None
    # Days stay texts; inferred, they would be numbers.
    schema = spark.read.parquet(path).drop("dt").schema.add("dt", "string")
    return spark.read.schema(schema).parquet(path)


def update(spans: DataFrame, path: str, batch: int | str, reach_days: int | None = None, unit: str = "day") -> None:
    """Merges a batch of spans into the store.

    Only days that hold a trace of the batch are rewritten. The new rows of these days are written aside
    under the batch's name first, so a batch that is repeated after a failure puts the same rows in
    place once more and counts nothing twice. ``reach_days`` says that spans of one trace start at most
    that many days apart; then only days around the batch are searched for its traces, else all of them.
    """
    spark, aside = spans.sparkSession, f"{path}/_merged/batch={batch}"
    if not _exists(spark, f"{aside}/_SUCCESS"):
        fresh = staged(trace_states(spans), "trace-states")
        ids, stored = fresh.select("trace_id"), _stored(spark, path)
        if stored is None:
            rows = fresh.withColumn("dt", _day(F.col("start_ns"), unit))
        else:
            near = stored
            if reach_days is not None:
                low, high = fresh.agg(F.min("start_ns"), F.max("last_start_ns")).first()
                if low is not None:
                    near = stored.filter(F.col("dt").between(_day_of(low, unit, -reach_days), _day_of(high, unit, reach_days)))
            old = staged(near.join(ids, "trace_id", "left_semi"), "known-states")
            both = old.unionByName(fresh.withColumn("dt", F.lit(None).cast("string")))
            changed = staged(merged_states(both).withColumn("dt", F.coalesce("dt", _day(F.col("start_ns"), unit))), "changed-states")
            days = staged(changed.select("dt").distinct(), "changed-days")
            untouched = stored.join(F.broadcast(days), "dt", "left_semi").join(ids, "trace_id", "left_anti")
            rows = untouched.unionByName(changed)
        rows.write.mode("overwrite").parquet(aside)
    merged = spark.read.parquet(aside)
    files = merged.groupBy("dt").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files"))
    file = F.pmod(F.xxhash64("trace_id"), F.col("_files"))
    (
        merged.join(F.broadcast(files), "dt").withColumn("_file", file)
        .repartition("dt", "_file").sortWithinPartitions("dt", F.desc("start_ns")).drop("_file", "_files")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    )


def kept_summary(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with the columns of :func:`traces.trace_summary`, and the day."""
    stored = _stored(spark, path)
    if stored is None:
        raise FileNotFoundError(f"no trace summary at {path}")
    return stored.select(
        "trace_id",
        F.col("first.service_name").alias("root_service"),
        F.col("first.operation_name").alias("root_operation"),
        F.col("first.span_id").alias("root_span_id"),
        (F.col("first.later_if_child") == 0).alias("has_root"),
        "span_count",
        "start_ns",
        "last_start_ns",
        "end_ns",
        (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
        "max_span_duration_ns",
        "error_count",
        (F.col("error_count") > 0).alias("has_error"),
        "services",
        F.size("services").cast("bigint").alias("service_count"),
        "dt",
    )


def newest(summary: DataFrame, limit: int, having: Column | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """The newest ``limit`` traces of the store that pass ``having``, from the days ``low`` to ``high``.

    Days are read from the newest back, twice as many each time. The number of traces that start within
    the days read, or later, is exact, and all others start before; so once it reaches the limit, older
    days can't matter. Only days and counts come to the driver.
    """
    if low is not None:
        summary = summary.filter(F.col("dt") >= low)
    if high is not None:
        summary = summary.filter(F.col("dt") <= high)
    if having is not None:
        summary = summary.filter(having)
    days = sorted((r.dt for r in summary.select("dt").distinct().collect()), reverse=True)
    take = 1
    while take < len(days):
        since = days[take - 1]
        found = summary.filter((F.col("dt") >= since) & (F.col("start_ns") >= _day_start_ns(since)))
        if found.limit(limit).count() >= limit:
            summary = summary.filter(F.col("dt") >= since)
            break
        take *= 2
    return summary.orderBy(F.desc("start_ns"), F.col("trace_id")).limit(limit)


def recent_traces(spark: SparkSession, path: str, limit: int = DEFAULT_RESULTS, service: str | None = None) -> DataFrame:
    """G2, O1 from the store."""
    having = None if service is None else F.array_contains("services", service)
    return summary_columns(newest(kept_summary(spark, path), limit, having))


def error_traces(spark: SparkSession, path: str, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """G6 from the store."""
    return summary_columns(newest(kept_summary(spark, path), limit, F.col("has_error")), search=True)


def list_traces(
    spark: SparkSession, path: str, service: str | None = None, start_ns: int | None = None, end_ns: int | None = None,
    limit: int = MAX_RESULTS, service_match: str = "all",
) -> DataFrame:
    """G5 from the store. The bounds on the starts of all spans are bounds on the trace's day as well."""
    having = F.lit(True)
    if service is not None:
        only = F.col("services") == F.array(F.lit(service))
        having = having & (only if service_match == "all" else F.array_contains("services", service))
    if start_ns is not None:
        having = having & (F.col("start_ns") >= start_ns)
    if end_ns is not None:
        having = having & (F.col("last_start_ns") <= end_ns)
    summary = kept_summary(spark, path)
    unit = _unit_of((summary.select("dt").first() or ["yyyyMMdd"])[0])
    low, high = (None if ns is None else _day_of(ns, unit) for ns in (start_ns, end_ns))
    return summary_columns(newest(summary, limit, having, low, high), search=True)
