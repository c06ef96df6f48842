"""Scalar functions F1-F11 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_US = 1_000
NS_PER_MS = 1_000_000
NS_PER_SEC = 1_000_000_000
NS_PER_MIN = 60 * NS_PER_SEC
NS_PER_HOUR = 3_600 * NS_PER_SEC
NS_PER_DAY = 86_400 * NS_PER_SEC

# Severity names with their lowest number; each class spans four numbers.
SEVERITY_NUMBERS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}

# Fixed value: bytes added per attribute or tag entry in the span size estimate.
ENTRY_OVERHEAD_BYTES = 48


def div(value: Column | str, by: int) -> Column:
    """Integer division that truncates, as BIGINT."""
    value = F.col(value) if isinstance(value, str) else value
    return F.call_function("div", value, F.lit(by).cast("bigint"))


# F3 -------------------------------------------------------------------------------------------
def span_end_ns() -> Column:
    return F.col("start_ns") + F.col("duration_ns")


def is_root() -> Column:
    return F.col("parent_span_id").isNull()


def is_error() -> Column:
    """Only the error status counts as an error; a missing status does not."""
    return F.coalesce(F.col("status") == "error", F.lit(False))


def duration_ms() -> Column:
    return div("duration_ns", NS_PER_MS)


# F4 -------------------------------------------------------------------------------------------
def ns_to_timestamp(ns: Column | str) -> Column:
    return F.timestamp_micros(div(ns, NS_PER_US))


def timestamp_to_ns(ts: Column | str) -> Column:
    return F.unix_micros(ts) * F.lit(NS_PER_US)


# F1, F2 ---------------------------------------------------------------------------------------
def _map_bytes(entries: Column, overhead: int) -> Column:
    size = F.aggregate(
        F.map_entries(entries),
        F.lit(0).cast("bigint"),
        lambda acc, e: acc
        + F.octet_length(e["key"])
        + F.coalesce(F.octet_length(e["value"]), F.lit(0))
        + F.lit(overhead),
    )
    return F.coalesce(size, F.lit(0).cast("bigint"))


def span_bytes(base_bytes: int = 0) -> Column:
    """Size estimate of a span: texts plus attribute and tag entries plus a fixed base."""
    texts = sum(
        (F.octet_length(c) for c in ("span_id", "service_name", "operation_name")),
        F.octet_length("trace_id"),
    )
    return (
        F.lit(base_bytes).cast("bigint")
        + texts
        + _map_bytes(F.col("attributes"), ENTRY_OVERHEAD_BYTES)
        + _map_bytes(F.col("tags"), ENTRY_OVERHEAD_BYTES)
    )


def log_bytes(base_bytes: int = 0, attributes_base: int = ENTRY_OVERHEAD_BYTES) -> Column:
    """Size estimate of a log record; the attribute map costs nothing when it is absent."""
    attrs = F.when(
        F.col("attributes").isNotNull(),
        F.lit(attributes_base).cast("bigint") + _map_bytes(F.col("attributes"), 0),
    ).otherwise(F.lit(0).cast("bigint"))
    return F.lit(base_bytes).cast("bigint") + F.octet_length("body") + attrs


# F7 -------------------------------------------------------------------------------------------
def severity_from_number(number: Column | str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    out = F.lit("INFO")
    for name, low in SEVERITY_NUMBERS.items():
        out = F.when(number.between(low, low + 3), F.lit(name)).otherwise(out)
    return out


def severity_number(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit(None).cast("int")
    for known, low in SEVERITY_NUMBERS.items():
        out = F.when(name == known, F.lit(low)).otherwise(out)
    return out


# F8 -------------------------------------------------------------------------------------------
def hash_bucket(key: Column | str, method: str = "xxhash64") -> Column:
    """A bucket in 0..9999. ``md5`` is slower but other engines can replay it."""
    if method == "xxhash64":
        return F.pmod(F.xxhash64(key), F.lit(10_000).cast("bigint"))
    head = F.substring(F.md5(F.col(key) if isinstance(key, str) else key), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(10_000).cast("bigint"))


def hash_keep(key: Column | str, rate_per_10000: Column | int, method: str = "xxhash64") -> Column:
    return hash_bucket(key, method) < rate_per_10000


# F9 -------------------------------------------------------------------------------------------
# Fixed value: what separates tokens, and the shortest token kept (in bytes).
TOKEN_SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]+"
MIN_TOKEN_BYTES = 3


def tokens(body: Column | str) -> Column:
    """Distinct lower-case alphanumeric tokens of more than two bytes."""
    body = F.col(body) if isinstance(body, str) else body
    parts = F.split(F.lower(body), TOKEN_SEPARATOR)
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= MIN_TOKEN_BYTES))


def query_tokens(query: str) -> list[str]:
    """White-space separated lower-case query words of more than two bytes."""
    words = (w for w in query.lower().split() if len(w.encode()) >= MIN_TOKEN_BYTES)
    return list(dict.fromkeys(words))


# F10 ------------------------------------------------------------------------------------------
def header_matches(query: str) -> Column:
    """Case-insensitive search over trace id, root service, root operation and any service."""
    q = query.lower()
    hit = F.exists("services", lambda s: F.lower(s).contains(q))
    for name in ("trace_id", "root_service", "root_operation"):
        hit = hit | F.lower(F.col(name)).contains(q)
    return hit


# F11 ------------------------------------------------------------------------------------------
def _quoted(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def pattern_positions(pattern: str, text: Column | str) -> Column:
    """Zero-based byte offsets of every occurrence, overlapping ones included.

    The text is split before each occurrence; the running length of the pieces is the offset. Every
    piece but the first starts with an occurrence, and the first does when the text does.
    """
    text = F.col(text) if isinstance(text, str) else text
    if not pattern:
        return F.array().cast("array<bigint>")
    pieces = F.split(text, f"(?={_quoted(pattern)})")
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found")
    )
    folded = F.aggregate(
        pieces,
        start,
        lambda acc, piece: F.struct(
            (acc["at"] + F.octet_length(piece)).alias("at"),
            F.when((acc["at"] > 0) | text.startswith(F.lit(pattern)), F.concat(acc["found"], F.array(acc["at"])))
            .otherwise(acc["found"])
            .alias("found"),
        ),
    )
    return folded["found"]


# Unit literals and time bounds ------------------------------------------------------------------
# Unit suffixes of duration literals, and of look-back bounds, in nanoseconds.
DURATION_UNITS = {
    "ns": 1,
    "us": NS_PER_US,
    "μs": NS_PER_US,
    "ms": NS_PER_MS,
    "s": NS_PER_SEC,
    "m": NS_PER_MIN,
}
LOOK_BACK_UNITS = {"s": NS_PER_SEC, "m": NS_PER_MIN, "h": NS_PER_HOUR, "d": NS_PER_DAY}


def parse_duration_ns(text: str) -> int:
    """``'100ms'`` to nanoseconds."""
    for unit in sorted(DURATION_UNITS, key=len, reverse=True):
        number = text[: -len(unit)]
        if text.endswith(unit) and number.isdigit():
            return int(number) * DURATION_UNITS[unit]
    raise ValueError(f"not a duration: {text!r}")


def parse_time_bound_ns(text: str, as_of_ns: int) -> int:
    """A look-back (``30m``, ``24h``, ``7d``), Unix seconds or nanoseconds, or an RFC 3339 time."""
    from datetime import datetime, timezone

    text = text.strip()
    if text.isdigit():
        number = int(text)
        return number * NS_PER_SEC if number < 10_000_000_000 else number
    if text[:-1].isdigit() and text[-1] in LOOK_BACK_UNITS:
        return as_of_ns - int(text[:-1]) * LOOK_BACK_UNITS[text[-1]]
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        raise ValueError(f"time zone missing: {text!r}")
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds
    return micros * NS_PER_US
