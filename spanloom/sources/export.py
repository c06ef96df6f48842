"""Export layouts and sinks B1-B9.

Nested layouts gather the spans of a trace in one document. A caller whose traces may be very large
gives ``parts``, one number for all traces: every trace is then dealt into that many documents by a hash
of the span id, and each document says how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators.traces import list_trace_ids, only_traces, summary_columns, trace_summary
from spanloom.sources.otlp import KINDS

EXPORT_LIMIT = 1_000
SCOPE_NAME = "spanloom"

# Codecs by compression level.
CODECS = {"none": "uncompressed", "fast": "lz4_raw", "balanced": "zstd", "maximum": "gzip"}
# Date patterns of the partition keys.
PARTITION_PATTERNS = {"month": "yyyyMM", "hour": "yyyyMMdd_HH", "day": "yyyyMMdd"}
HOT_FOR_NS = 5 * S.NS_PER_MIN


# Selection ----------------------------------------------------------------------------------------
def select_traces(
    spans: DataFrame,
    service: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    limit: int = EXPORT_LIMIT,
    errors_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Trace headers and their spans; errors are picked among the listed traces."""
    chosen = only_traces(spans, list_trace_ids(spans, service, start_ns, end_ns, limit))
    headers = summary_columns(trace_summary(chosen), search=True)
    if errors_only:
        headers = headers.filter("has_error")
        chosen = only_traces(chosen, headers)
    return headers, chosen


def one_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of one trace; an error when there is none."""
    found = spans.filter(F.col("trace_id") == trace_id)
    if found.isEmpty():
        raise LookupError(f"trace not found: {trace_id}")
    return found


def with_parts(spans: DataFrame, parts: int = 1) -> DataFrame:
    """Adds the part of its trace a span is written in and the number of parts; the same for all traces."""
    if parts == 1:
        return spans.withColumns({"part": F.lit(0), "part_count": F.lit(1)})
    return spans.withColumn("part", F.pmod(F.xxhash64("span_id"), F.lit(parts)).cast("int")).withColumn("part_count", F.lit(parts))


# B1 -----------------------------------------------------------------------------------------------
# Keys first, so that sorting the structs sorts the spans by start.
_SPAN_FIELDS = (
    "start_ns",
    "span_id",
    "parent_span_id",
    "service_name",
    "operation_name",
    "duration_ns",
    "kind",
    "status",
    "status_message",
)


def json_spans(spans: DataFrame) -> DataFrame:
    """B1: one JSON text per span."""
    return spans.select("trace_id", F.to_json(F.struct(*spans.columns)).alias("json"))


def _nested_spans(spans: DataFrame, parts: int) -> DataFrame:
    """The spans of a trace (and part), in order of start."""
    # Maps cannot be sorted; they travel as entries inside the sort struct.
    span = F.struct(*_SPAN_FIELDS, F.map_entries("attributes").alias("attributes"))
    return (
        with_parts(spans, parts)
        .groupBy("trace_id", "part")
        .agg(F.sort_array(F.collect_list(span)).alias("sorted"))
        .withColumns(
            {
                "part_count": F.lit(parts),
                "spans": F.transform(
                    "sorted",
                    lambda s: F.struct(
                        *[s[f].alias(f) for f in _SPAN_FIELDS], F.map_from_entries(s["attributes"]).alias("attributes")
                    ),
                ),
            }
        )
    )


def _json_documents(nested: DataFrame, header: list[str]) -> DataFrame:
    return nested.select(
        "trace_id", "part", F.to_json(F.struct("trace_id", *header, "part", "part_count", "spans")).alias("json")
    )


def json_traces(headers: DataFrame, spans: DataFrame, parts: int = 1) -> DataFrame:
    """B1: one JSON text per trace (and part): the trace header with its spans by start."""
    header = [c for c in headers.columns if c not in ("trace_id", "services")]
    nested = _nested_spans(spans, parts).drop("sorted")
    return _json_documents(headers.join(nested, "trace_id"), header)


def json_whole_traces(spans: DataFrame) -> DataFrame:
    """B1: :func:`json_traces` in one part: the spans are all there, so the search header is read off them.

    Spans that lie by trace already are not shuffled.
    """
    root = F.get(F.filter("sorted", lambda s: s["parent_span_id"].isNull()), F.lit(0))
    header = {
        "root_service": F.when(F.col("_root").isNotNull(), F.col("_root.service_name")).otherwise("unknown"),
        "root_operation": F.when(F.col("_root").isNotNull(), F.col("_root.operation_name")).otherwise("unknown"),
        "span_count": F.size("sorted").cast("bigint"),
        "duration_ns": F.array_max("sorted.duration_ns"),
        "start_ns": F.array_min("sorted.start_ns"),
        "has_error": F.exists("sorted", lambda s: F.coalesce(s["status"] == "error", F.lit(False))),
    }
    nested = _nested_spans(spans.filter(F.col("trace_id").isNotNull()), 1).withColumn("_root", root)
    return _json_documents(nested.withColumns(header), list(header))


# B2 -----------------------------------------------------------------------------------------------
def _jaeger_span() -> Column:
    """A span in Jaeger's layout. Values are JSON texts where the type differs by tag."""
    tag = lambda key, kind, value: F.struct(
        key.alias("key"), F.lit(kind).alias("type"), value.alias("value")
    )
    tags = F.transform(F.map_entries("attributes"), lambda e: tag(e["key"], "string", e["value"]))
    failed = F.array(tag(F.lit("error"), "bool", F.lit("true")))
    reference = F.struct(
        F.lit("CHILD_OF").alias("refType"),
        F.col("trace_id").alias("traceID"),
        F.col("parent_span_id").alias("spanID"),
    )
    no_references = F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>")
    return F.struct(
        F.col("trace_id").alias("traceID"),
        F.col("span_id").alias("spanID"),
        F.col("parent_span_id").alias("parentSpanID"),
        F.col("operation_name").alias("operationName"),
        F.when(F.col("parent_span_id").isNotNull(), F.array(reference)).otherwise(no_references).alias("references"),
        S.div("start_ns", S.NS_PER_US).alias("startTime"),
        S.div("duration_ns", S.NS_PER_US).alias("duration"),
        F.when(S.is_error(), F.concat(tags, failed)).otherwise(tags).alias("tags"),
        F.array().cast("array<string>").alias("logs"),
        F.col("service_name").alias("processID"),
    )


def _bare_booleans(json: Column) -> Column:
    """Tag values are texts in the struct; the ``bool`` ones become JSON booleans."""
    return F.regexp_replace(json, r'"type":"bool","value":"(true|false)"', r'"type":"bool","value":$1')


def jaeger_traces(spans: DataFrame, parts: int = 1) -> DataFrame:
    """B2: one Jaeger document per trace (and part).

    Spans travel once, as plain columns, to the task of their document.
    """
    keyed = F.struct("start_ns", "span_id", _jaeger_span().alias("span"))
    process = F.transform(
        F.sort_array("services"),
        lambda s: F.struct(
            s.alias("key"),
            F.struct(s.alias("serviceName"), F.array().cast("array<string>").alias("tags")).alias("value"),
        ),
    )
    return (
        with_parts(spans, parts)
        .repartition("trace_id", "part")
        .groupBy("trace_id", "part")
        .agg(F.sort_array(F.collect_list(keyed)).alias("keyed"), F.collect_set("service_name").alias("services"))
        .select(
            "trace_id",
            "part",
            _bare_booleans(
                F.to_json(
                    F.struct(
                        F.col("trace_id").alias("traceID"),
                        F.transform("keyed", lambda k: k["span"]).alias("spans"),
                        F.map_from_entries(process).alias("processes"),
                    )
                )
            ).alias("json"),
        )
    )


# B3 -----------------------------------------------------------------------------------------------
def _kind_code() -> Column:
    code = F.lit(1)
    for number, name in KINDS.items():
        if number:
            code = F.when(F.col("kind") == name, F.lit(number)).otherwise(code)
    return code


def _otlp_attributes(entries: Column) -> Column:
    return F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")),
    )


def _runs(rows: Column, key: str) -> Column:
    """Cuts an array of structs, sorted by ``key`` first, into arrays of equal ``key``; looks at every row twice."""
    places = F.sequence(F.lit(1), F.size(rows))
    starts = F.filter(places, lambda i: (i == 1) | ~F.get(rows, i - 1)[key].eqNullSafe(F.get(rows, i - 2)[key]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(rows) + 1))
    return F.zip_with(starts, ends, lambda start, end: F.slice(rows, start, end - start))


def otlp_traces(spans: DataFrame, parts: int = 1) -> DataFrame:
    """One OTLP request per trace (and part), spans grouped by service.

    The spans of a document are gathered once, as plain values, and cut into services inside its row. Spans
    that lie by trace already are not shuffled.
    """
    span = lambda s: F.struct(
        F.col("trace_id").alias("traceId"),
        s["span_id"].alias("spanId"),
        s["parent_span_id"].alias("parentSpanId"),
        s["operation_name"].alias("name"),
        s["kind_code"].alias("kind"),
        s["start_ns"].cast("string").alias("startTimeUnixNano"),
        (s["start_ns"] + s["duration_ns"]).cast("string").alias("endTimeUnixNano"),
        _otlp_attributes(s["attributes"]).alias("attributes"),
        F.struct(s["status_code"].alias("code"), s["status_message"].alias("message")).alias("status"),
    )
    resource = lambda name: F.struct(
        F.array(
            F.struct(F.lit("service.name").alias("key"), F.struct(name.alias("stringValue")).alias("value"))
        ).alias("attributes")
    )
    scope = lambda run: F.struct(
        F.struct(F.lit(SCOPE_NAME).alias("name")).alias("scope"), F.transform(run, span).alias("spans")
    )
    # Maps cannot be sorted; they travel as entries. Services first, so that sorting groups them.
    plain = F.struct(
        "service_name",
        "start_ns",
        "span_id",
        "parent_span_id",
        "operation_name",
        _kind_code().alias("kind_code"),
        "duration_ns",
        F.map_entries("attributes").alias("attributes"),
        F.when(S.is_error(), 2).otherwise(1).alias("status_code"),
        "status_message",
    )
    return (
        with_parts(spans, parts)
        .groupBy("trace_id", "part")
        .agg(F.sort_array(F.collect_list(plain)).alias("sorted"))
        .select("trace_id", "part", _runs(F.col("sorted"), "service_name").alias("runs"))
        .select(
            "trace_id",
            "part",
            F.to_json(
                F.struct(
                    F.transform(
                        "runs",
                        lambda run: F.struct(
                            resource(run[0]["service_name"]).alias("resource"), F.array(scope(run)).alias("scopeSpans")
                        ),
                    ).alias("resourceSpans")
                )
            ).alias("json"),
        )
    )


# B4 -----------------------------------------------------------------------------------------------
def csv_rows(spans: DataFrame) -> DataFrame:
    """Nine columns; the duration is in ns and says so."""
    return spans.select(
        "trace_id",
        "span_id",
        F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id"),
        F.col("service_name").alias("service"),
        F.col("operation_name").alias("operation"),
        F.col("start_ns").alias("start_time"),
        "duration_ns",
        F.when(S.is_error(), "ERROR").otherwise("OK").alias("status"),
        F.to_json("attributes").alias("attributes"),
    )


def write_csv(spans: DataFrame, path: str) -> None:
    csv_rows(spans).write.option("header", True).option("escape", '"').csv(path)


def write_json_lines(documents: DataFrame, path: str, compression: str = "none") -> None:
    """One document per line; a ``gzip`` file is small and read by one task."""
    documents.select(F.col("json").alias("value")).write.text(path, compression=compression)


# B8 -----------------------------------------------------------------------------------------------
def partition_key(unit: str = "day") -> Column:
    """``20240131``, ``20240131_17``, the month ``202401`` or the ISO week ``2024W05``."""
    ts = S.ns_to_timestamp("start_ns")
    if unit == "week":
        year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
        week = F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0")
        return F.concat(year, F.lit("W"), week)
    return F.date_format(ts, PARTITION_PATTERNS[unit])


def tier(as_of_ns: int, hot_for_ns: int = HOT_FOR_NS) -> Column:
    return F.when(F.col("start_ns") < as_of_ns - hot_for_ns, "cold").otherwise("hot")


def write_spans(spans: DataFrame, path: str, unit: str = "day", level: str = "balanced", files_per_key: int = 8) -> None:
    """Parquet partitioned by time key, rows sorted by service for pruning inside files.

    Rows of a key are spread over ``files_per_key`` tasks by trace, so a busy day is not one task.
    """
    keyed = spans.withColumn("dt", partition_key(unit)).withColumn(
        "_file", F.pmod(F.xxhash64("trace_id"), F.lit(files_per_key))
    )
    (
        keyed.repartition("dt", "_file")
        .sortWithinPartitions("dt", "service_name", "start_ns")
        .drop("_file")
        .write.mode("append")
        .partitionBy("dt")
        .option("compression", CODECS[level])
        .parquet(path)
    )


def write_tiers(
    spans: DataFrame, path: str, as_of_ns: int, unit: str = "day", hot_for_ns: int = HOT_FOR_NS, files_per_key: int = 8
) -> None:
    """Old spans with strong compression, the newest ones with fast compression."""
    of = tier(as_of_ns, hot_for_ns)
    write_spans(spans.filter(of == "cold"), f"{path}/cold", unit, "maximum", files_per_key)
    write_spans(spans.filter(of == "hot"), f"{path}/hot", unit, "fast", files_per_key)


# B9 -----------------------------------------------------------------------------------------------
def trace_events(batch: DataFrame) -> DataFrame:
    """One row per trace of an ingest batch: first service, spans, first start."""
    return batch.groupBy("trace_id").agg(
        F.min_by("service_name", F.struct("start_ns", "span_id")).alias("service_name"),
        F.count(F.lit(1)).alias("span_count"),
        F.min("start_ns").alias("ts_ns"),
    )
