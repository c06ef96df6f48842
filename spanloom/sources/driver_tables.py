"""Span, metric and log tables derived from the order, line item and event tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scalars as S


def _padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _attributes(kind: Column, status: Column, duration_ns: Column) -> Column:
    """Attributes that follow from the other columns, so SQL can restate them."""
    price = S.div(duration_ns, 10_000)
    return F.create_map(
        F.lit("span.kind"),
        kind,
        F.lit("http.status_code"),
        F.when(status == "error", F.lit("500")).otherwise(F.lit("200")),
        F.lit("cache.hit"),
        F.when(price % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit("retry.count"),
        (price % 5).cast("string"),
    )


def derive_spans(orders: DataFrame, lineitem: DataFrame, by_trace: bool = False) -> DataFrame:
    """One root span per order and one span per (order, line number).

    ``by_trace`` shuffles orders and lines once, by the trace they belong to: what groups the spans by
    trace then needs no shuffle of its own. A trace's spans are made in one task, row by row, so this is for
    queries that make one row of a trace; others take the spans as they come, where a large trace is spread.
    """
    day_ns = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    offset_ns = (F.col("o_orderkey") % 86400) * F.lit(S.NS_PER_SEC)
    if by_trace:
        orders = orders.withColumn("trace_id", _padded(F.col("o_orderkey"), 32)).repartition("trace_id")
        lineitem = lineitem.withColumn("trace_id", _padded(F.col("l_orderkey"), 32)).repartition("trace_id")
    roots = orders.select(
        "trace_id" if by_trace else _padded(F.col("o_orderkey"), 32).alias("trace_id"),
        _padded(F.col("o_orderkey") * 10, 16).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("gateway").alias("service_name"),
        F.col("o_orderpriority").alias("operation_name"),
        (day_ns + offset_ns).alias("start_ns"),
        (F.floor("o_totalprice").cast("bigint") * 10000).alias("duration_ns"),
        F.lit("server").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "ok").otherwise("unset").alias("status"),
    )
    # Lines are combined before they meet their order, so a hot order is small by then. The two
    # one-letter flags are compared by code, which keeps this a hash aggregate.
    trace = ["trace_id"] if by_trace else []
    lines = lineitem.groupBy(*trace, "l_orderkey", "l_linenumber").agg(
        F.max("l_suppkey").alias("suppkey"),
        F.char(F.max(F.ascii("l_returnflag"))).alias("returnflag"),
        F.char(F.max(F.ascii("l_linestatus"))).alias("linestatus"),
        F.max("l_extendedprice").alias("price"),
        F.max("l_quantity").alias("quantity"),
    )
    dates = orders.select(*trace, F.col("o_orderkey").alias("l_orderkey"), day_ns.alias("day_ns"))
    if by_trace:
        # The key of a trace is that of its order.
        dates = dates.drop("l_orderkey").hint("shuffle_hash")
    line = F.col("l_linenumber")
    children = lines.join(dates, "trace_id" if by_trace else "l_orderkey").select(
        "trace_id" if by_trace else _padded(F.col("l_orderkey"), 32).alias("trace_id"),
        _padded(F.col("l_orderkey") * 10 + line, 16).alias("span_id"),
        _padded(F.col("l_orderkey") * 10 + line - 1, 16).alias("parent_span_id"),
        F.concat(F.lit("svc-"), line.cast("string"), F.lit("-"), (F.col("suppkey") % 3).cast("string")).alias(
            "service_name"
        ),
        F.concat("returnflag", F.lit("/"), "linestatus").alias("operation_name"),
        (
            F.col("day_ns")
            + (F.col("l_orderkey") % 86400) * F.lit(S.NS_PER_SEC)
            + line * F.lit(S.NS_PER_MS)
        ).alias("start_ns"),
        (F.floor("price").cast("bigint") * 10000).alias("duration_ns"),
        F.when(line == 1, "client").otherwise("internal").alias("kind"),
        F.when((F.col("returnflag") == "R") & (F.col("quantity") > 45), "error")
        .otherwise("ok")
        .alias("status"),
    )
    empty = F.create_map().cast("map<string,string>")
    return roots.unionByName(children).select(
        "*",
        F.when(F.col("status") == "error", F.lit("returned")).alias("status_message"),
        _attributes(F.col("kind"), F.col("status"), F.col("duration_ns")).alias("attributes"),
        empty.alias("tags"),
        empty.alias("resource_attributes"),
    )


def _event_service() -> Column:
    return F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string"))


def _event_ns() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) * 1000


def derive_metric_points(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        _event_ns().alias("ts_ns"),
        _event_service().alias("service_name"),
        kind.alias("metric_name"),
        F.when(kind == "error", F.lit(0.8))
        .when(kind == "purchase", F.col("value") * F.lit(20.0) + F.lit(1000.5))
        .otherwise(F.col("value"))
        .alias("value"),
    )


def derive_logs(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    severity = (
        F.when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARN")
        .when(kind == "signup", "INFO")
        .when(kind == "click", "DEBUG")
        .otherwise("TRACE")
    )
    body = F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" props "), "props")
    return events.select(
        "event_id",
        _event_ns().alias("ts_ns"),
        _event_service().alias("service_name"),
        F.when(F.col("event_id") % 2 == 0, _padded(F.col("event_id"), 32)).alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        severity.alias("severity"),
        S.severity_number(severity).alias("severity_number"),
        body.alias("body"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )


def derive_document_logs(documents: DataFrame) -> DataFrame:
    """Documents as long log bodies: the source is the service, the id the time."""
    return documents.select(
        F.col("doc_id").alias("event_id"),
        F.col("doc_id").alias("ts_ns"),
        F.col("source").alias("service_name"),
        F.col("text").alias("body"),
    )


@dataclass
class Tables:
    """The signal tables of one data folder, as lazily read DataFrames."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def spans(self) -> DataFrame:
        return derive_spans(self.raw("orders"), self.raw("lineitem"))

    @cached_property
    def spans_by_trace(self) -> DataFrame:
        """The same spans, those of a trace in one partition."""
        return derive_spans(self.raw("orders"), self.raw("lineitem"), by_trace=True)

    @cached_property
    def metric_points(self) -> DataFrame:
        return derive_metric_points(self.raw("events"))

    @cached_property
    def logs(self) -> DataFrame:
        return derive_logs(self.raw("events"))

    @cached_property
    def document_logs(self) -> DataFrame:
        return derive_document_logs(self.raw("documents"))
