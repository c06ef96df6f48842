"""Span and trace filters C1-C17 as Python predicates over columns.

``field.service == "api"``, ``field.attr("http.status_code") >= 400`` and
``field.duration > "100ms"`` build filters; ``&`` and ``|`` combine them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators.traces import checked_limit

DEFAULT_LIMIT = 1_000
MAX_LIMIT = 10_000


@dataclass(frozen=True)
class Filter:
    """A test on single spans, or a combination of tests."""

    test: Column | None = None
    joined_by: str | None = None
    parts: tuple["Filter", ...] = ()

    def __and__(self, other: "Filter") -> "Filter":
        return Filter(joined_by="and", parts=(self, other))

    def __or__(self, other: "Filter") -> "Filter":
        return Filter(joined_by="or", parts=(self, other))

    def tests(self) -> list[Column]:
        """The single-span tests from left to right."""
        if self.test is not None:
            return [self.test]
        return [t for part in self.parts for t in part.tests()]

    def combine(self, values: list[Column]) -> Column:
        """The combination applied to one value per entry of :meth:`tests`."""
        rest = iter(values)

        def walk(node: Filter) -> Column:
            if node.test is not None:
                return next(rest)
            left, right = (walk(p) for p in node.parts)
            return left & right if node.joined_by == "and" else left | right

        return walk(self)


def everything() -> Filter:
    """C14: the empty query."""
    return Filter(F.lit(True))


class _Field:
    def __init__(self, column: Column):
        self.column = column

    def _pair(self, value: object) -> tuple[Column, Column]:
        return self.column, F.lit(value)

    def __eq__(self, value: object) -> Filter:  # type: ignore[override]
        left, right = self._pair(value)
        return Filter(left == right)

    def __ne__(self, value: object) -> Filter:  # type: ignore[override]
        left, right = self._pair(value)
        return Filter(left != right)

    def __gt__(self, value: object) -> Filter:
        left, right = self._pair(value)
        return Filter(left > right)

    def __ge__(self, value: object) -> Filter:
        left, right = self._pair(value)
        return Filter(left >= right)

    def __lt__(self, value: object) -> Filter:
        left, right = self._pair(value)
        return Filter(left < right)

    def __le__(self, value: object) -> Filter:
        left, right = self._pair(value)
        return Filter(left <= right)

    def matches(self, pattern: str) -> Filter:
        """Unanchored regular expression (Java syntax)."""
        return Filter(self.column.rlike(pattern))

    def contains(self, text: str) -> Filter:
        """C11: case-sensitive substring."""
        return Filter(self.column.contains(text))

    __hash__ = None  # type: ignore[assignment]


class _Duration(_Field):
    """Compared in whole microseconds, written as bounds in ns so that scans can use them."""

    @staticmethod
    def _us(value: object) -> int:
        return (S.parse_duration_ns(value) if isinstance(value, str) else int(value)) // S.NS_PER_US  # type: ignore[call-overload]

    def _at_least(self, us: int) -> Column:
        return self.column >= F.lit(us * S.NS_PER_US)

    def _below(self, us: int) -> Column:
        return self.column < F.lit(us * S.NS_PER_US)

    def __eq__(self, value: object) -> Filter:  # type: ignore[override]
        us = self._us(value)
        return Filter(self._at_least(us) & self._below(us + 1))

    def __ne__(self, value: object) -> Filter:  # type: ignore[override]
        us = self._us(value)
        return Filter(self._below(us) | self._at_least(us + 1))

    def __gt__(self, value: object) -> Filter:
        return Filter(self._at_least(self._us(value) + 1))

    def __ge__(self, value: object) -> Filter:
        return Filter(self._at_least(self._us(value)))

    def __lt__(self, value: object) -> Filter:
        return Filter(self._below(self._us(value)))

    def __le__(self, value: object) -> Filter:
        return Filter(self._below(self._us(value) + 1))

    __hash__ = None  # type: ignore[assignment]


class _Status(_Field):
    """C4: ``unknown`` also covers spans that never set a status."""

    def _is(self, value: object) -> Column:
        return self.column.isin("unknown", "unset") if value == "unknown" else self.column == F.lit(value)

    def __eq__(self, value: object) -> Filter:  # type: ignore[override]
        return Filter(self._is(value))

    def __ne__(self, value: object) -> Filter:  # type: ignore[override]
        return Filter(~self._is(value))

    __hash__ = None  # type: ignore[assignment]


class _Attribute(_Field):
    """Text attributes; numbers compare as numbers, booleans as ``true`` / ``false``."""

    def _pair(self, value: object) -> tuple[Column, Column]:
        if isinstance(value, bool):
            return self.column, F.lit("true" if value else "false")
        if isinstance(value, (int, float)):
            return self.column.try_cast("double"), F.lit(float(value))
        return self.column, F.lit(value)


class _Fields:
    """The fields of a span. Properties, because columns need a running session."""

    _COLUMNS = {
        "service": "service_name",
        "name": "operation_name",
        "operation": "operation_name",
        "trace_id": "trace_id",
        "span_id": "span_id",
        "parent_span_id": "parent_span_id",
        "kind": "kind",
    }

    def __getattr__(self, name: str) -> _Field:
        if name not in self._COLUMNS:
            raise AttributeError(name)
        return _Field(F.col(self._COLUMNS[name]))

    @property
    def duration(self) -> _Field:
        return _Duration(F.col("duration_ns"))

    @property
    def status(self) -> _Field:
        return _Status(F.col("status"))

    @staticmethod
    def attr(key: str) -> _Field:
        return _Attribute(F.col("attributes")[key])


field = _Fields()


def filter_spans(spans: DataFrame, wanted: Filter) -> DataFrame:
    """Spans that satisfy the whole filter themselves."""
    return spans.filter(wanted.combine(wanted.tests()))


def matching_traces(spans: DataFrame, wanted: Filter, mode: str = "trace") -> DataFrame:
    """Ids of matching traces, with the start of their newest matching span.

    In ``trace`` mode different spans may satisfy the two sides of a combination; in ``span`` mode
    one span must satisfy all of it. Filters have no negation, so spans that pass no single test
    cannot matter and are dropped at the scan.
    """
    tests = wanted.tests()
    newest = F.max("start_ns").alias("start_ns")
    if mode == "span":
        return filter_spans(spans, wanted).groupBy("trace_id").agg(newest)
    if mode != "trace":
        raise ValueError(f"unknown mode: {mode!r}")
    relevant = tests[0]
    for test in tests[1:]:
        relevant = relevant | test
    hits = [F.coalesce(F.bool_or(t), F.lit(False)).alias(f"_t{i}") for i, t in enumerate(tests)]
    combined = wanted.combine([F.col(f"_t{i}") for i in range(len(tests))])
    return (
        spans.filter(relevant).groupBy("trace_id").agg(newest, *hits).filter(combined).select("trace_id", "start_ns")
    )


def run_filter(
    spans: DataFrame, wanted: Filter, limit: int | None = None, mode: str = "trace"
) -> DataFrame:
    """The newest matching traces, with the number of matches before the limit.

    A limit above ``MAX_LIMIT`` is an error; :func:`matching_traces` has none.
    """
    limit = checked_limit(limit, DEFAULT_LIMIT, MAX_LIMIT)
    found = matching_traces(spans, wanted, mode)
    total = found.agg(F.count(F.lit(1))).scalar()
    return (
        found.orderBy(F.desc("start_ns"), "trace_id")
        .limit(limit)
        .select(
            F.lpad("trace_id", 32, "0").alias("trace_id"),
            "start_ns",
            total.alias("total_matches"),
            (total > limit).alias("limited"),
        )
    )


def since(spans: DataFrame, as_of_ns: int, hours: int = 24) -> DataFrame:
    """C17: spans of the last hours before ``as_of_ns``."""
    return spans.filter(F.col("start_ns") >= as_of_ns - hours * S.NS_PER_HOUR)
