"""OTLP/JSON sources and ingestion transforms A1-A10, A12."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spanloom import schema
from spanloom.functions import scalars as S

# Conventional resource keys with the columns they fill.
RESOURCE_KEYS = {
    "service.name": "service_name",
    "service.version": "service_version",
    "service.namespace": "service_namespace",
    "deployment.environment": "deployment_environment",
    "host.name": "host_name",
    "container.id": "container_id",
    "process.pid": "process_pid",
    "telemetry.sdk.name": "telemetry_sdk_name",
    "telemetry.sdk.version": "telemetry_sdk_version",
    "telemetry.sdk.language": "telemetry_sdk_language",
}

# Span kinds and status names by code.
KINDS = {0: "internal", 1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUSES = {1: "ok", 2: "error"}

# Limits of a valid span. The years are 2000 and 2100.
YEAR_2000_NS = 946_684_800 * S.NS_PER_SEC
YEAR_2100_NS = 4_102_444_800 * S.NS_PER_SEC
MAX_TRACE_ID, MAX_SPAN_ID, MAX_SERVICE_NAME = 32, 16, 255
_HEX = "^[0-9a-fA-F]+$"


# A5 -----------------------------------------------------------------------------------------------
# These expressions are nested lambdas; as SQL text they take one call instead of hundreds.
_NO_ENTRIES = "cast(array() as array<struct<key:string,value:string>>)"


def _number_sql(value: str) -> str:
    """Shortest decimal text: no trailing ``.0``, and no exponent where a decimal holds the value."""
    text, exact = f"cast({value} as string)", f"try_cast({value} as decimal(38,18))"
    plain = f"regexp_replace(cast({exact} as string), '[.]?0+$', '')"
    return (
        f"if(contains({text}, 'E'), if(cast({exact} as double) = {value}, {plain}, {text}),"
        f" regexp_replace({text}, '[.]0$', ''))"
    )


def any_value_sql(value: str, depth: int = schema.NESTING) -> str:
    """A5: AnyValue as text; arrays as ``[a, b]``, key/value lists as ``{k=v}``, bytes by length."""
    if depth > 0:
        item, pair = f"v{depth}", f"p{depth}"
        items = f"transform({value}.arrayValue.values, {item} -> {any_value_sql(item, depth - 1)})"
        pairs = (
            f"transform({value}.kvlistValue.values,"
            f" {pair} -> concat({pair}.key, '=', {any_value_sql(pair + '.value', depth - 1)}))"
        )
        nested = f"concat('[', array_join({items}, ', '), ']'), concat('{{', array_join({pairs}, ', '), '}}')"
    else:
        nested = f"{value}.arrayValue, {value}.kvlistValue"
    return (
        f"coalesce({value}.stringValue, cast({value}.boolValue as string), {value}.intValue,"
        f" {_number_sql(value + '.doubleValue')}, {nested},"
        f" concat('bytes(', octet_length(unbase64({value}.bytesValue)), ')'), '')"
    )


def _entries_sql(attributes: str, key: str = "a.key", unless: str = "") -> str:
    """Attributes that carry a value, as key and text, but for those with the key ``unless``; an empty array when there are none."""
    other = f" and a.key <> '{unless}'" if unless else ""
    present = f"filter({attributes}, a -> a.key is not null and a.value is not null{other})"
    return (
        f"coalesce(transform({present}, a -> named_struct('key', {key}, 'value', {any_value_sql('a.value')})),"
        f" {_NO_ENTRIES})"
    )


def with_first_wins(df: DataFrame, column: str) -> DataFrame:
    """Turns a column of ``key``/``value`` entries into a map in which the first of equal keys counts.

    Entries whose keys all differ, and are there, are the map as they stand; only others are gone through.
    """
    keys = F.col(f"{column}.key")
    differ = F.size(F.array_except(keys, F.array(F.lit(None).cast("string")))) == F.size(column)
    first = F.filter(column, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return df.withColumn(column, F.when(differ, F.map_from_entries(column)).otherwise(F.map_from_entries(first)))


# A6 -----------------------------------------------------------------------------------------------
def _rfc3339_sql(ns: str) -> str:
    """UTC time with as many fraction digits, in groups of three, as the value has."""
    part = f"{ns} % {S.NS_PER_SEC}"
    return (
        f"concat(date_format(timestamp_seconds({ns} div {S.NS_PER_SEC}), \"yyyy-MM-dd'T'HH:mm:ss\"),"
        f" case when {part} = 0 then ''"
        f" when {part} % {S.NS_PER_MS} = 0 then concat('.', lpad({part} div {S.NS_PER_MS}, 3, '0'))"
        f" when {part} % {S.NS_PER_US} = 0 then concat('.', lpad({part} div {S.NS_PER_US}, 6, '0'))"
        f" else concat('.', lpad({part}, 9, '0')) end, '+00:00')"
    )


def event_entries_sql(events: str) -> str:
    """``event.{i}.name``, ``.time`` (RFC 3339) and ``.{key}`` of every span event."""
    ns = "coalesce(try_cast(e.timeUnixNano as bigint), 0L)"
    fixed = (
        f"array(named_struct('key', concat('event.', i, '.name'), 'value', coalesce(e.name, '')),"
        f" named_struct('key', concat('event.', i, '.time'), 'value', {_rfc3339_sql(ns)}))"
    )
    extra = _entries_sql("e.attributes", "concat('event.', i, '.', a.key)")
    return f"coalesce(flatten(transform({events}, (e, i) -> concat({fixed}, {extra}))), {_NO_ENTRIES})"


# A7 -----------------------------------------------------------------------------------------------
def _by_code(code: Column, names: dict[int, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def kind_name(code: Column) -> Column:
    return _by_code(code, KINDS, "internal")


def status_name(code: Column) -> Column:
    return _by_code(code, STATUSES, "unknown")


# A4 -----------------------------------------------------------------------------------------------
def resource_columns(df: DataFrame, resource_map: str = "resource_attributes", default_service: str = "unknown") -> DataFrame:
    """A4: a column per conventional resource key."""
    values = {
        column: F.try_element_at(F.col(resource_map), F.lit(key)) for key, column in RESOURCE_KEYS.items()
    }
    values["service_name"] = F.coalesce(values["service_name"], F.lit(default_service))
    values["process_pid"] = values["process_pid"].try_cast("int")
    return df.withColumns(values)


def _service(resource_map: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(resource_map, F.lit("service.name")), F.lit(default))


# A1 -----------------------------------------------------------------------------------------------
_DAMAGED = "_damaged"


def _shape(signal: str) -> StructType:
    shapes = {"traces": schema.OTLP_TRACES, "metrics": schema.OTLP_METRICS, "logs": schema.OTLP_LOGS}
    return StructType([*shapes[signal], StructField(_DAMAGED, StringType())])


def read_otlp(spark: SparkSession, path: str, signal: str = "traces", stream: bool = False) -> DataFrame:
    """OTLP/JSON requests, one per line, as nested rows; see :func:`malformed_requests` for the rest."""
    return parse_otlp(read_lines(spark, path, stream), "line", signal)


def read_lines(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """The lines of the files that are not blank, with the file each comes from.

    ``max_files`` bounds the files of a micro-batch of a stream.
    """
    reader = spark.readStream if stream else spark.read
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))
    return lines.filter(F.trim("line") != "")


def parsed(texts: DataFrame, column: str, signal: str = "traces") -> DataFrame:
    """All texts with their ``request`` and whether it is ``readable``; see :func:`requests_of`, :func:`unreadable`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED}
    request = F.from_json(column, _shape(signal), options)
    # A text that is JSON but no object gives an empty request; it is damaged too.
    object_like = F.coalesce(F.col(column), F.lit("")).rlike(r"^\s*\{")
    # Exploded, a request is parsed once; the tests on a plain column would each parse it again in the filter.
    return texts.select("*", F.explode(F.array(request)).alias("request")).withColumn(
        "readable", F.col("request").isNotNull() & F.col(f"request.{_DAMAGED}").isNull() & object_like
    )


def parse_otlp(texts: DataFrame, column: str, signal: str = "traces") -> DataFrame:
    """Requests from a column of JSON texts."""
    return requests_of(parsed(texts, column, signal))


def requests_of(texts: DataFrame) -> DataFrame:
    """The requests of :func:`parsed` texts."""
    return texts.filter("readable").select("request.*").drop(_DAMAGED)


def unreadable(texts: DataFrame) -> DataFrame:
    """The :func:`parsed` texts that hold no request, with the reason."""
    return texts.filter("not readable").drop("request", "readable").withColumn("reject_reason", F.lit("malformed_request"))


_MALFORMED = "_malformed"


def flatten_lines(texts: DataFrame) -> DataFrame:
    """The spans of :func:`parsed` texts and the texts that hold no request, from one parse; see :func:`malformed_lines`.

    A text without a request travels as one span without content that keeps the text.
    """
    requests = texts.schema["request"].dataType["resourceSpans"].dataType
    scopes = requests.elementType["scopeSpans"].dataType
    scope = F.struct(F.lit(None).cast(scopes.elementType["scope"].dataType).alias("scope"), F.array(F.lit(None).cast(scopes.elementType["spans"].dataType.elementType)).alias("spans"))
    resource = F.struct(F.lit(None).cast(requests.elementType["resource"].dataType).alias("resource"), F.array(scope).alias("scopeSpans"))
    own = F.struct(*[c for c in texts.columns if c not in ("request", "readable")])
    rows = texts.select(
        F.when(F.col("readable"), F.col("request.resourceSpans")).otherwise(F.array(resource)).alias("resourceSpans"),
        F.when(~F.col("readable"), own).alias(_MALFORMED),
    )
    return flatten_spans(rows, [_MALFORMED])


def span_lines(flat: DataFrame) -> DataFrame:
    """The spans of :func:`flatten_lines`."""
    return flat.filter(F.col(_MALFORMED).isNull()).drop(_MALFORMED)


def malformed_lines(flat: DataFrame) -> DataFrame:
    """The texts of :func:`flatten_lines` that hold no request, with the reason."""
    return flat.filter(F.col(_MALFORMED).isNotNull()).select(f"{_MALFORMED}.*", F.lit("malformed_request").alias("reject_reason"))


def malformed_requests(texts: DataFrame, column: str, signal: str = "traces") -> DataFrame:
    """The texts that are no requests, with all their columns and the reason; nothing else is lost.

    Good and malformed texts together are all texts.
    """
    return unreadable(parsed(texts, column, signal))


def _by_resource(requests: DataFrame, resources: str, scopes: str, kept: Sequence[str] = ()) -> DataFrame:
    """One row per scope, with the attributes of its resource as a map and the ``kept`` columns."""
    by_resource = requests.select(*kept, F.explode(resources).alias("r")).select(
        *kept, F.expr(_entries_sql("r.resource.attributes")).alias("resource_attributes"), F.col(f"r.{scopes}").alias("scopes")
    )
    return with_first_wins(by_resource, "resource_attributes").select(
        *kept, "resource_attributes", F.explode("scopes").alias("s")
    )


def flatten_spans(requests: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """One row per span, not yet validated; keeps ``end_ns`` for the checks, and the ``kept`` columns."""
    span = F.col("span")
    parent = F.lower(span["parentSpanId"])
    rows = (
        _by_resource(requests, "resourceSpans", "scopeSpans", kept)
        .select(*kept, "resource_attributes", F.explode("s.spans").alias("span"))
        .select(
            *kept,
            F.lower(F.coalesce(span["traceId"], F.lit(""))).alias("trace_id"),
            F.lower(F.coalesce(span["spanId"], F.lit(""))).alias("span_id"),
            F.when(~parent.rlike("^0*$"), parent).alias("parent_span_id"),
            _service(F.col("resource_attributes"), "unknown").alias("service_name"),
            F.coalesce(span["name"], F.lit("")).alias("operation_name"),
            F.coalesce(span["startTimeUnixNano"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("start_ns"),
            F.coalesce(span["endTimeUnixNano"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("end_ns"),
            kind_name(span["kind"]).alias("kind"),
            status_name(span["status"]["code"]).alias("status"),
            span["status"]["message"].alias("message"),
            # The kind of the span goes first, so no attribute of that name counts.
            F.expr(f"concat({_entries_sql('span.attributes', unless='span.kind')}, {event_entries_sql('span.events')})").alias("attributes"),
            "resource_attributes",
        )
        .withColumn("attributes", F.expr("concat(array(named_struct('key', 'span.kind', 'value', kind)), attributes)"))
    )
    return with_first_wins(rows, "attributes").select(
        "trace_id",
        "span_id",
        "parent_span_id",
        F.when(F.col("service_name") == "", "unknown").otherwise(F.col("service_name")).alias("service_name"),
        "operation_name",
        "start_ns",
        (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"),
        "kind",
        "status",
        F.when(F.col("status") == "error", F.col("message")).alias("status_message"),
        "attributes",
        F.create_map().cast("map<string,string>").alias("tags"),
        "resource_attributes",
        "end_ns",
        *kept,
    )


# A8, A9 -------------------------------------------------------------------------------------------
def reject_reason() -> Column:
    """Why a span is invalid, NULL when it is valid. The first failing check counts."""
    in_range = lambda c: F.col(c).between(YEAR_2000_NS, YEAR_2100_NS)
    return (
        F.when(F.col("trace_id").rlike("^0*$"), "trace_id_empty_or_zero")
        .when(F.col("span_id").rlike("^0*$"), "span_id_empty_or_zero")
        .when(~F.col("trace_id").rlike(_HEX), "trace_id_not_hex")
        .when(~F.col("span_id").rlike(_HEX), "span_id_not_hex")
        .when(~F.col("parent_span_id").rlike(_HEX), "parent_span_id_not_hex")
        .when(F.length("trace_id") > MAX_TRACE_ID, "trace_id_too_long")
        .when(F.length("span_id") > MAX_SPAN_ID, "span_id_too_long")
        .when(F.length("parent_span_id") > MAX_SPAN_ID, "parent_span_id_too_long")
        .when(F.octet_length("service_name") > MAX_SERVICE_NAME, "service_name_too_long")
        .when(F.col("start_ns") == 0, "start_time_zero")
        .when(F.col("end_ns") == 0, "end_time_zero")
        .when(~in_range("start_ns"), "start_time_out_of_range")
        .when(~in_range("end_ns"), "end_time_out_of_range")
        .when(F.col("end_ns") < F.col("start_ns"), "end_before_start")
        .when(F.col("duration_ns") > S.NS_PER_DAY, "duration_too_long")
    )


def validate_spans(flat: DataFrame) -> DataFrame:
    """Adds ``reject_reason``; the batch as a whole always succeeds."""
    return flat.withColumn("reject_reason", reject_reason())


def valid_spans(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason", "end_ns")


def rejected_spans(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def compliance_error() -> Column:
    """Strict id lengths and a service name."""
    return (
        F.when(F.length("trace_id") != MAX_TRACE_ID, "invalid_trace_id")
        .when(F.length("span_id") != MAX_SPAN_ID, "invalid_span_id")
        .when(F.coalesce(F.length("service_name"), F.lit(0)) == 0, "missing_service_name")
    )


# A10 ----------------------------------------------------------------------------------------------
def parse_traceparent(header: Column | str) -> Column:
    """A10: ``struct(trace_id, span_id, flags)``, NULL when the header is not of version 00."""
    header = F.col(header) if isinstance(header, str) else header
    parts = F.split(header, "-")
    flags = F.get(parts, F.lit(3))
    good = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "00") & flags.rlike(r"^\+?0*[0-9a-fA-F]{1,2}$")
    number = F.conv(F.regexp_replace(flags, r"^\+", ""), 16, 10).cast("int")
    return F.when(
        good,
        F.struct(
            F.get(parts, F.lit(1)).alias("trace_id"), F.get(parts, F.lit(2)).alias("span_id"), number.alias("flags")
        ),
    )


def create_traceparent(trace_id: Column | str, span_id: Column | str, sampled: Column) -> Column:
    """A10: the inverse."""
    return F.format_string("00-%s-%s-%s", trace_id, span_id, F.when(sampled, "01").otherwise("00"))


# A12 ----------------------------------------------------------------------------------------------
def latest_spans(spans: DataFrame, arrival: str) -> DataFrame:
    """The last arrival of every (trace, span). Copies are merged before the shuffle."""
    keys = ["trace_id", "span_id"]
    rest = [c for c in spans.columns if c not in keys]
    return (
        spans.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_last")).select(*keys, "_last.*")
    )


# A2 -----------------------------------------------------------------------------------------------
def flatten_metrics(requests: DataFrame) -> DataFrame:
    """A2: gauge and sum values, histogram sums above zero, summary means. Others are skipped.

    A missing time is the time of processing.
    """
    now = S.timestamp_to_ns(F.current_timestamp())
    metric = _by_resource(requests, "resourceMetrics", "scopeMetrics").select(
        _service(F.col("resource_attributes"), "unknown_service").alias("service_name"),
        F.explode("s.metrics").alias("m"),
    )

    def points(source: str, value) -> Column:
        return F.transform(
            F.coalesce(F.col(f"m.{source}.dataPoints"), F.array()),
            lambda p: F.named_struct(
                F.lit("ts_ns"), p["timeUnixNano"].try_cast("bigint"), F.lit("value"), value(p).cast("double")
            ),
        )

    def number(p: Column) -> Column:
        return F.coalesce(p["asDouble"], p["asInt"].try_cast("double"))

    def mean(p: Column) -> Column:
        count = p["count"].try_cast("double")
        return F.when((p["sum"] > 0) & (count > 0), p["sum"] / count)

    every = F.concat(
        points("gauge", number),
        points("sum", number),
        points("histogram", lambda p: F.when(p["sum"] > 0, p["sum"])),
        points("summary", mean),
    )
    return (
        metric.select("service_name", F.col("m.name").alias("metric_name"), F.explode(every).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .select(F.coalesce(F.when(F.col("p.ts_ns") > 0, F.col("p.ts_ns")), now).alias("ts_ns"), "service_name", "metric_name", "p.value")
    )


# A3 -----------------------------------------------------------------------------------------------
def flatten_logs(requests: DataFrame) -> DataFrame:
    """A3: log records; a missing time is the time of processing."""
    record = _by_resource(requests, "resourceLogs", "scopeLogs").select(
        _service(F.col("resource_attributes"), "unknown_service").alias("service_name"),
        F.explode("s.logRecords").alias("l"),
    )
    log = F.col("l")
    ns = log["timeUnixNano"].try_cast("bigint")
    severity = S.severity_from_number(F.coalesce(log["severityNumber"], F.lit(0)))
    ids = {n: F.when(log[k] != "", F.lower(log[k])) for n, k in (("trace_id", "traceId"), ("span_id", "spanId"))}
    rows = record.select(
        F.coalesce(F.when(ns > 0, ns), S.timestamp_to_ns(F.current_timestamp())).alias("ts_ns"),
        "service_name",
        F.when(F.length(ids["trace_id"]) <= MAX_TRACE_ID, ids["trace_id"]).alias("trace_id"),
        F.when(F.length(ids["span_id"]) <= MAX_SPAN_ID, ids["span_id"]).alias("span_id"),
        severity.alias("severity"),
        F.when(log["body"].isNotNull(), F.expr(any_value_sql("l.body"))).otherwise("").alias("body"),
        F.when(F.size(log["attributes"]) > 0, F.expr(_entries_sql("l.attributes"))).alias("attributes"),
    )
    return with_first_wins(rows, "attributes").withColumn("severity_number", S.severity_number("severity"))
