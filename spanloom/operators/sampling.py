"""Sampling policies P1-P12 over spans and complete traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import quantile as Q
from spanloom.functions import scalars as S
from spanloom.operators.ranked import look_back, prefix_sums
from spanloom.operators.services import latency_ema
from spanloom.session import staged

# Fixed values of the policies.
BASE_RATE = 100  # per 10 000: 1 %
SLOW_MS = 1_000
MANY_SPANS = 100
MANY_SERVICES = 5
TARGET_TPS = 1_000.0
ERROR_BOOST = 10
HIGH_ERROR_RATE = 0.05
MAX_RATE = 10_000
TIER_RATES = {"critical": 10_000, "high": 5_000, "medium": 1_000, "low": 100, "minimal": 0}
TIER_SHARES = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "minimal": 0.2}
TIER_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "minimal": 4}
VERY_SLOW_MS = 5_000
FAN_OUT = 10
HUGE_TRACE = 500
HISTORY = 1_000
MIN_HISTORY = 100
Z_LIMIT = 3.0
# Intervals of a run, and runs of a run of runs, in P6.
RUN = 512


def _lookup(column: str, values: Mapping[str, float | int]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col(column) == name, F.lit(value)).otherwise(out)
    return out


def uniform_sample(spans: DataFrame, rate: float, seed: int = 0, method: str = "rand") -> DataFrame:
    """Each span with the same chance; by a hash of its ids and the seed it is drawn alike on every run."""
    if method == "rand":
        return spans.filter(F.rand(seed) < rate)
    key = F.concat("trace_id", "span_id", F.lit(str(seed)))
    return spans.filter(S.hash_bucket(key, method) < F.lit(rate) * 10_000)


def service_rates(
    spans: DataFrame, rates: Mapping[str, float], default: float, by_trace: bool = True, method: str = "xxhash64"
) -> DataFrame:
    """A rate per service. ``by_trace`` decides by trace id, the same way on every run."""
    rate = F.lit(float(default))
    for service, value in rates.items():
        rate = F.when(F.col("service_name") == service, F.lit(float(value))).otherwise(rate)
    draw = S.hash_bucket("trace_id", method) / F.lit(10_000.0) if by_trace else F.rand()
    return spans.filter((rate >= 1.0) | ((rate > 0.0) & (draw < rate)))


def head_decision(rate_per_10000: int = BASE_RATE, method: str = "xxhash64") -> Column:
    """Keep / defer / drop from the trace id alone."""
    bucket = S.hash_bucket("trace_id", method)
    return (
        F.when(bucket < BASE_RATE, "keep").when(bucket < rate_per_10000, "defer").otherwise("drop")
    )


def tail_decisions(features: DataFrame, method: str = "xxhash64") -> DataFrame:
    """The decision and its reason for every complete trace."""
    reason = (
        F.when(F.col("has_error"), "error")
        .when(F.col("max_span_duration_ns") > SLOW_MS * S.NS_PER_MS, "slow")
        .when(F.col("span_count") > MANY_SPANS, "complex")
        .when(F.col("service_count") > MANY_SERVICES, "wide")
        .when(S.hash_keep("trace_id", BASE_RATE, method), "sampled")
        .otherwise("normal")
    )
    return features.withColumn("reason", reason).withColumn("keep", F.col("reason") != "normal")


def tail_reason(has_error: bool, max_span_ns: int, span_count: int, service_count: int, drawn: bool) -> str:
    """The reason of :func:`tail_decisions` for one trace, from its features; ``drawn`` is the hash test."""
    if has_error:
        return "error"
    if max_span_ns > SLOW_MS * S.NS_PER_MS:
        return "slow"
    if span_count > MANY_SPANS:
        return "complex"
    if service_count > MANY_SERVICES:
        return "wide"
    return "sampled" if drawn else "normal"


def kept_spans(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans of the traces that are kept."""
    return spans.join(decisions.filter("keep").select("trace_id"), "trace_id", "left_semi")


def with_priority(features: DataFrame) -> DataFrame:
    """P11."""
    return features.withColumn(
        "priority",
        F.when(F.col("has_error"), "critical")
        .when(F.col("duration_ms") > SLOW_MS, "high")
        .when(F.col("span_count") > MANY_SPANS, "medium")
        .otherwise("low"),
    )


def with_anomaly(
    features: DataFrame,
    keys: Sequence[str] = ("root_service",),
    history: int = HISTORY,
    min_history: int = MIN_HISTORY,
    chunk_rows: int = 20_000,
) -> DataFrame:
    """Anomalous against the traces that started before it with the same keys.

    Mean and variance are whole numbers, as in the definition. Needs ``duration_ms``,
    ``span_count``, ``service_count``, ``start_ns`` and ``trace_id``.
    """
    ms = F.col("duration_ms").cast("decimal(19,0)")
    sums = {"_ms": ms, "_ms2": (ms * ms).cast("decimal(38,0)"), "_spans": F.col("span_count")}
    seen = look_back(
        features, list(keys), ["start_ns", "trace_id"], history, sums, chunk_rows=max(chunk_rows, history)
    )
    n = F.col("seen").cast("decimal(19,0)")
    mean = F.call_function("div", F.col("_ms"), n)
    squares = F.col("_ms2") - F.lit(2) * mean * F.col("_ms") + n * mean * mean
    variance = F.call_function("div", squares.cast("decimal(38,0)"), n)
    distance = F.abs(F.col("duration_ms") - F.col("_mean")).cast("double")
    # A constant history has no spread: any other duration is then infinitely far away.
    far = F.when(F.col("_variance") == 0, distance > 0).otherwise(
        distance / F.sqrt(F.col("_variance").cast("double")) > Z_LIMIT
    )
    enough = F.col("seen") >= min_history
    mean_spans = F.call_function("div", F.col("_spans"), F.col("seen"))
    odd_duration = (F.col("duration_ms") > VERY_SLOW_MS) | (F.coalesce(enough & far, F.lit(False)))
    odd_size = (F.col("span_count") > HUGE_TRACE) | F.coalesce(
        enough & (F.col("span_count") > F.when(enough, mean_spans) * 5), F.lit(False)
    )
    filled = F.col("seen") > 0
    return (
        seen.withColumns({"_mean": F.when(filled, mean)})
        .withColumns({"_variance": F.when(filled, variance)})
        .withColumns({"odd_duration": odd_duration, "odd_size": odd_size, "odd_fan_out": F.col("service_count") > FAN_OUT})
        .withColumn("is_anomalous", F.col("odd_duration") | F.col("odd_size") | F.col("odd_fan_out"))
        .drop(*sums, "_mean", "_variance", "seen")
    )


def smart_decisions(features: DataFrame, has_capacity: bool = True, method: str = "xxhash64") -> DataFrame:
    """P5: error, slow and anomalous traces stay; then the budget; then the tier's rate.

    Needs ``is_anomalous`` (P7) and ``priority`` (P11).
    """
    reason = (
        F.when(F.col("has_error"), "error")
        .when(F.col("duration_ms") > SLOW_MS, "slow")
        .when(F.col("is_anomalous"), "anomalous")
        .when(~F.lit(has_capacity), "over_budget")
        .when(S.hash_bucket("trace_id", method) < _lookup("priority", TIER_RATES), "sampled")
        .otherwise("not_sampled")
    )
    return features.withColumn("reason", reason).withColumn(
        "keep", ~F.col("reason").isin("over_budget", "not_sampled")
    )


def budgeted_decisions(
    features: DataFrame, budget_bytes: int, used_bytes: int = 0, method: str = "xxhash64", bytes_column: str = "bytes"
) -> DataFrame:
    """P5 with P8: :func:`smart_decisions` of traces in start order, each against what was kept before it.

    Errors, slow and anomalous traces are always kept and use the budget too. All others are kept at
    their tier's rate until the general cut, a fifth below the budget, is reached; from there on they
    are over budget. What is used never shrinks, so up to the cut every drawn trace was kept: one running
    sum over the traces that are kept or drawn says where the cut falls.
    """
    by_rate = smart_decisions(features, method=method)
    would_use = F.when(F.col("keep"), F.col(bytes_column)).otherwise(F.lit(0)).cast("bigint")
    summed = prefix_sums(by_rate, [], ["start_ns", "trace_id"], {"_upto": would_use})
    cut = budget_bytes - budget_bytes // 5
    over = (F.col("_upto") - would_use + used_bytes >= cut) & F.col("reason").isin("sampled", "not_sampled")
    return (
        summed.withColumn("_over", over)
        .withColumn("reason", F.when(F.col("_over"), "over_budget").otherwise(F.col("reason")))
        .withColumn("keep", F.col("keep") & ~F.col("_over"))
        .drop("_upto", "_upto_total", "_over")
    )


# P6 ----------------------------------------------------------------------------------------------
def next_rate(rate: int, tps: float, error_rate: float, target_tps: float = TARGET_TPS) -> int:
    """One step of the adaptive rate, per 10 000."""
    ratio = min(max(target_tps / max(tps, 1.0), 0.5), 1.5)
    stepped = min(max(int(rate * ratio), 1), MAX_RATE)
    return min(stepped * ERROR_BOOST, MAX_RATE) if error_rate > HIGH_ERROR_RATE else stepped


def load_per_interval(features: DataFrame, interval_seconds: int = 60) -> DataFrame:
    """Traces per second and error rate of every interval that has traces."""
    width = interval_seconds * S.NS_PER_SEC
    return (
        features.groupBy(S.div("start_ns", width).alias("interval"))
        .agg(F.count(F.lit(1)).alias("traces"), F.count_if("has_error").alias("errors"))
        .select(
            "interval",
            (F.col("traces") / F.lit(float(interval_seconds))).alias("tps"),
            (F.col("errors") / F.col("traces")).alias("error_rate"),
        )
    )


def _steps(rates: np.ndarray, tps: float, error_rate: float, target_tps: float) -> np.ndarray:
    """:func:`next_rate` of many rates at once."""
    ratio = min(max(target_tps / max(tps, 1.0), 0.5), 1.5)
    stepped = np.clip((rates * ratio).astype(np.int64), 1, MAX_RATE)
    return np.minimum(stepped * ERROR_BOOST, MAX_RATE) if error_rate > HIGH_ERROR_RATE else stepped


def adaptive_rates(load: DataFrame, start_rate: int = BASE_RATE, target_tps: float = TARGET_TPS) -> DataFrame:
    """The rate after every interval.

    Each step needs the one before, but a rate is one of ``MAX_RATE`` numbers, so what a run of
    intervals does is a table from the rate before to the rate after. Runs of intervals get their tables
    in parallel, runs of runs compose them, and only those - one for many thousand intervals - are
    followed in order. The rates at the borders are then handed back down to the runs.
    """
    run, runs = F.floor(F.col("interval") / RUN), F.floor(F.col("run") / RUN)
    rows = staged(load.select("interval", "tps", "error_rate", run.alias("run")), "load")

    def table(key, pdf):
        rates = np.arange(MAX_RATE + 1, dtype=np.int64)
        for r in pdf.sort_values("interval").itertuples():
            rates = _steps(rates, r.tps, r.error_rate, target_tps)
        return pd.DataFrame({"run": [key[0]], "after": [rates.astype("<i4").tobytes()]})

    tables = staged(rows.groupBy("run").applyInPandas(table, "run long, after binary").withColumn("runs", runs), "run-tables")

    def composed(key, pdf):
        rates = np.arange(MAX_RATE + 1)
        for after in pdf.sort_values("run")["after"]:
            rates = np.frombuffer(after, dtype="<i4")[rates]
        return pd.DataFrame({"runs": [key[0]], "after": [rates.astype("<i4").tobytes()]})

    top = tables.groupBy("runs").applyInPandas(composed, "runs long, after binary")
    starts, rate = [], start_rate
    for r in sorted(top.collect(), key=lambda r: r.runs):  # a row for RUN * RUN intervals
        starts.append((r.runs, rate))
        rate = int(np.frombuffer(r.after, dtype="<i4")[rate])

    def borders(key, pdf):
        pdf, rate, before = pdf.sort_values("run"), int(pdf["before"].iloc[0]), []
        for after in pdf["after"]:
            before.append(rate)
            rate = int(np.frombuffer(after, dtype="<i4")[rate])
        return pd.DataFrame({"run": pdf["run"], "before": before})

    begun = load.sparkSession.createDataFrame(starts, "runs long, before long")
    begun = tables.join(begun, "runs").groupBy("runs").applyInPandas(borders, "run long, before long")

    def fold(key, pdf):
        pdf, rate, rates = pdf.sort_values("interval"), int(pdf["before"].iloc[0]), []
        for tps, error_rate in zip(pdf["tps"], pdf["error_rate"]):
            rate = next_rate(rate, tps, error_rate, target_tps)
            rates.append(rate)
        return pdf[["interval", "tps", "error_rate"]].assign(rate=rates)

    return rows.join(begun, "run").groupBy("run").applyInPandas(fold, "interval long, tps double, error_rate double, rate long")


# P8, P9 ------------------------------------------------------------------------------------------
def budget_plan(
    sized: DataFrame, budget_bytes: int, used_bytes: int = 0, bytes_column: str = "bytes"
) -> DataFrame:
    """Which traces fit when the most important are stored first, oldest first within a tier.

    A trace fits while the bytes up to and including it stay below its tier's share of the budget.
    """
    ordered = sized.withColumn("_tier", _lookup("priority", TIER_ORDER))
    summed = prefix_sums(
        ordered, [], ["_tier", "start_ns", "trace_id"], {"bytes_upto": F.col(bytes_column).cast("bigint")}
    )
    share = F.floor(_lookup("priority", TIER_SHARES) * F.lit(float(budget_bytes)) + F.lit(1e-6))
    return summed.withColumn("admitted", F.col("bytes_upto") + used_bytes < share).drop("_tier", "bytes_upto_total")


def has_capacity(budget_bytes: int, used_bytes: int) -> bool:
    """The general cut: a fifth of the budget is kept for critical traces."""
    return used_bytes < budget_bytes - budget_bytes // 5


def sized_traces(spans: DataFrame) -> DataFrame:
    """Bytes and start per trace."""
    return spans.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.sum(S.span_bytes()).alias("bytes"))


def budget_statistics(sized: DataFrame, budget_bytes: int, first_average: float = 10_000.0) -> DataFrame:
    """Fill level, moving average of the trace size, traces that still fit, bytes to free.

    The average moves by a tenth towards every stored trace, in start order, from ``first_average``.
    """
    sizes = sized.select(F.lit(0).alias("_all"), "start_ns", "trace_id", F.col("bytes").cast("double").alias("bytes"))
    seed = sized.sparkSession.range(1).select(
        F.lit(0).alias("_all"),
        F.lit(-1).cast("bigint").alias("start_ns"),
        F.lit("").alias("trace_id"),
        F.lit(float(first_average)).alias("bytes"),
    )
    ema = latency_ema(sizes.unionByName(seed), ["_all"], ["start_ns", "trace_id"], "bytes").select("ema")
    used = F.col("used_bytes")
    budget = F.lit(budget_bytes).cast("bigint")
    return (
        sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("used_bytes"))
        .withColumn("avg_trace_bytes", F.floor(ema.scalar()).cast("bigint"))
        .withColumns(
            {
                "budget_bytes": budget,
                "available_bytes": budget - used,
                "reserved_bytes": S.div(budget, 5),
                "usage_percent": used / budget * 100,
                "traces_remaining": F.call_function(
                    "div", F.greatest(budget - used, F.lit(0)), F.greatest("avg_trace_bytes", F.lit(1))
                ),
                "cleanup_bytes": F.when(used > S.div(budget * 9, 10), S.div(budget, 5))
                .when(used > S.div(budget * 8, 10), S.div(budget, 10))
                .otherwise(F.lit(0).cast("bigint")),
            }
        )
    )


def latency_baselines(spans: DataFrame) -> DataFrame:
    """P10: p50, p95 and p99 in ms per service over the given history."""
    q = F.percentile_approx(S.duration_ms(), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 1000)
    return (
        spans.groupBy("service_name")
        .agg(q.alias("q"), F.count(F.lit(1)).alias("samples"))
        .select("service_name", "samples", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))])
    )


def exact_baselines(spans: DataFrame) -> DataFrame:
    """P10 with exact rank percentiles."""
    timed = spans.select("service_name", S.duration_ms().alias("ms"))
    return Q.rank_quantiles(
        timed,
        ["service_name"],
        "ms",
        {f"p{p}_ms": Q.percent_index(p) for p in (50, 95, 99)},
        carry={"samples": (F.count(F.lit(1)), F.sum)},
        buckets=Q.bit_buckets("ms", 10),
    )


def decision_statistics(decisions: DataFrame) -> DataFrame:
    """Traces evaluated and kept, and the kept share."""
    return decisions.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("keep").alias("kept")).withColumn(
        "keep_ratio", F.when(F.col("evaluated") > 0, F.col("kept") / F.col("evaluated")).otherwise(F.lit(0.0))
    )
