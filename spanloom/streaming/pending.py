"""Q3: pending traces as keyed state. Spans wait for their trace's decision and are released by it.

A trace is pending from the arrival of its first span on, for a fixed time. A timer ends the wait: the
trace is decided once, by the rule of P4, and its spans leave with the decision. The decision itself is
kept until a second timer, and spans that come late follow it at once.

Traces are dealt into buckets by a hash of their id, and a bucket is one key of the state. Each call to
the state store costs a round trip between Python and Spark; a bucket's spans and decisions go there as
chunks of many rows, so the calls grow with buckets and micro-batches and not with spans or traces.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructField, StructType

from spanloom.functions import scalars as S
from spanloom.operators import sampling

# Fixed value: longest wait for a trace, in seconds.
WAIT_SECONDS = 30
#: How far the clocks of receivers may be apart.
LATENESS = "10 seconds"
#: Seconds a decision is kept for late spans.
KEEP_SECONDS = 600
#: Keys of the state that traces are dealt into.
BUCKETS = 128
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BUCKET, _ARRIVAL, _DRAWN, _FAILED, _LENGTH = "_bucket", "_arrival_ms", "_drawn", "_failed", "_length_ns"


def use_rocksdb(spark: SparkSession) -> None:
    """Lists and timers need the state store on disk, which also holds more traces than memory does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as a chunk of state; ids and names of spans repeat, so a chunk is compressed."""
    return (zlib.compress(pickle.dumps(rows), 1),)


class PendingTraces(StatefulProcessor):
    """Buffers the spans of a bucket's traces, decides each when its wait is over and remembers the decision for a while."""

    def __init__(self, names: list[str], columns: list[str], wait_ms: int, keep_ms: int):
        self.names, self.columns, self.wait_ms, self.keep_ms = names, columns, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "chunk binary")
        self.decisions = handle.getListState("decisions", "chunk binary")

    def _rows(self, state) -> pd.DataFrame | None:
        chunks = [pickle.loads(zlib.decompress(r[0])) for r in state.get()]
        return pd.concat(chunks, ignore_index=True) if chunks else None

    def _replace(self, state, rows: pd.DataFrame) -> None:
        state.clear()
        if len(rows):
            state.appendValue(_packed(rows))

    def _released(self, spans: pd.DataFrame, decided: pd.DataFrame, at, late: bool) -> pd.DataFrame:
        """``spans`` with the rows of ``decided`` that stand at the positions ``at``."""
        return spans[self.names].assign(reason=decided["reason"].to_numpy()[at], keep=decided["keep"].to_numpy()[at], late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided, first = self._rows(self.decisions), None
        for spans in rows:
            spans.columns = self.columns  # Spark renames those that begin with an underscore
            if decided is not None:
                at = pd.Index(decided["trace_id"]).get_indexer(spans["trace_id"])
                if (at >= 0).any():
                    yield self._released(spans[at >= 0], decided, at[at >= 0], True)
                spans = spans[at < 0]
            if len(spans):
                self.spans.appendValue(_packed(spans))
                arrived = int(spans[_ARRIVAL].min())
                first = arrived if first is None else min(first, arrived)
        if first is not None:
            self.handle.registerTimer(first + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, timers = timerValues.getCurrentWatermarkInMs(), []
        decided = self._rows(self.decisions)
        if decided is not None:
            if decided["until_ms"].min() <= now:
                decided = decided[decided["until_ms"] > now]
                self._replace(self.decisions, decided)
            timers.append(decided["until_ms"].min())
        spans = self._rows(self.spans)
        if spans is not None:
            by_trace = spans.groupby("trace_id", dropna=False, sort=False)
            due = by_trace[_ARRIVAL].transform("min") + self.wait_ms <= now
            waiting = spans[~due]
            if due.any():
                made = self._decided(spans[due])
                self.decisions.appendValue(_packed(made))
                at = pd.Index(made["trace_id"]).get_indexer(spans["trace_id"][due])
                yield self._released(spans[due], made, at, False)
                self._replace(self.spans, waiting)
                timers.append(made["until_ms"].min())
            timers.append(waiting[_ARRIVAL].min() + self.wait_ms)
        timers = [t for t in timers if pd.notna(t)]
        if timers:
            self.handle.registerTimer(int(min(timers)))

    def _decided(self, spans: pd.DataFrame) -> pd.DataFrame:
        """The decision of every trace of ``spans``, and the time until which it holds."""
        by_trace = spans.groupby("trace_id", dropna=False, sort=False)
        seen = by_trace.agg(
            failed=(_FAILED, "any"), longest=(_LENGTH, "max"), spans=(_FAILED, "size"),
            services=("service_name", "nunique"), drawn=(_DRAWN, "any"), first=(_ARRIVAL, "min"),
        ).reset_index()
        features = zip(*(seen[c].tolist() for c in ("failed", "longest", "spans", "services", "drawn")))
        reason = [sampling.tail_reason(*f) for f in features]
        until = seen["first"] + (self.wait_ms + self.keep_ms)
        return pd.DataFrame({"trace_id": seen["trace_id"], "reason": reason, "keep": [r != "normal" for r in reason], "until_ms": until})


def released_spans(
    spans: DataFrame,
    arrival: str = "start_time",
    wait_seconds: int = WAIT_SECONDS,
    keep_seconds: int = KEEP_SECONDS,
    lateness: str = LATENESS,
    method: str = "xxhash64",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every span with its trace's ``reason`` and ``keep``, once that trace is decided; a streaming DataFrame.

    ``arrival`` is the time of receipt, the clock of both timers; by default it is the span's start.
    Spark drops rows that are not newer than the watermark, so a time stamped on receipt loses none as
    long as receivers agree within ``lateness``. A
    trace is decided ``wait_seconds`` after its first span; ``late`` spans came after that and follow
    the decision for ``keep_seconds``. Spans that come still later begin a new trace. There is no limit
    to the number of pending traces and none is given up undecided. ``buckets`` has to stay the same as long as a checkpoint is used.
    """
    use_rocksdb(spans.sparkSession)
    if arrival == "start_time" and arrival not in spans.columns:
        spans = spans.withColumn(arrival, S.ns_to_timestamp("start_ns"))
    span = spans.schema
    # Numbers travel as texts: pandas has no NULL in whole numbers and would make them inexact.
    numbers = {f.name: f.dataType for f in span if isinstance(f.dataType, IntegralType)}
    timed = spans.withWatermark(arrival, lateness).withColumns(
        {
            _BUCKET: F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int"),
            _ARRIVAL: F.coalesce(F.unix_millis(arrival), F.lit(0)).cast("bigint"),
            _DRAWN: F.coalesce(S.hash_keep("trace_id", sampling.BASE_RATE, method), F.lit(False)),
            _FAILED: F.coalesce(S.is_error(), F.lit(False)),
            _LENGTH: F.coalesce("duration_ns", F.lit(0)).cast("bigint"),
        }
    ).withColumns({c: F.col(c).cast("string") for c in numbers})
    carried = [StructField(f.name, StringType()) if f.name in numbers else f for f in span]
    out = StructType([*carried, StructField("reason", StringType()), StructField("keep", BooleanType()), StructField("late", BooleanType())])
    released = timed.groupBy(_BUCKET).transformWithStateInPandas(
        PendingTraces(span.names, timed.columns, wait_seconds * 1000, keep_seconds * 1000), out, "Append", "EventTime"
    )
    return released.withColumns({c: F.col(c).cast(kind) for c, kind in numbers.items()})
