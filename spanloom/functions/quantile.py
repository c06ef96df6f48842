"""Exact rank percentiles J2, J4, J5 over groups of any size, and the approximate J3.

A percentile here is "the value at this zero-based index of the sorted values", which differs from
the SQL percentile functions. It is found in column-pruned passes that never bring a whole group
into one task:

1. count rows per (group, bucket of the value) with map-side combine, then walk the bucket totals
   of each group to find the bucket that holds the wanted index;
2. keep only the rows of those buckets, count them per finer bucket or per value, and walk those.

A bucket is a range of values, so every walk sees a bounded number of rows per group: the number of
buckets in one bucket of the pass before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.joins import join_null_safe
from spanloom.session import staged

Rank = Callable[[Column], Column]

def percent_index(percent: int) -> Rank:
    """Index ``n * percent div 100``."""
    return lambda n: F.call_function("div", n * F.lit(percent), F.lit(100).cast("bigint"))


def disc_index(p: float) -> Rank:
    """SQL's discrete percentile: the first value at or above the share ``p`` of the rows, in exact numbers."""
    share = Fraction(str(p))
    up, down = F.lit(share.numerator).cast("bigint"), F.lit(share.denominator).cast("bigint")
    return lambda n: F.greatest(F.call_function("div", n * up + down - 1, down) - 1, F.lit(0).cast("bigint"))


def sample_index(p: float) -> Rank:
    """Index ``floor((n - 1) * p)``."""
    return lambda n: F.floor((n - 1).cast("double") * F.lit(float(p))).cast("bigint")


def scaled_index(p: float) -> Rank:
    """Index ``floor(n * p)``, at most ``n - 1``."""
    return lambda n: F.least(F.floor(n.cast("double") * F.lit(float(p))).cast("bigint"), n - 1)


def descending_index(p: float) -> Rank:
    """Index ``floor(n * p)`` of the values sorted from the largest down."""
    return lambda n: n - 1 - F.floor(n.cast("double") * F.lit(float(p))).cast("bigint")


def bit_buckets(value: Column | str, *bits: int) -> list[Column]:
    """Buckets of a BIGINT value of ``2**bits`` values each, from coarse to fine."""
    value = F.col(value) if isinstance(value, str) else value
    return [F.shiftright(value, b) for b in bits]


def duration_buckets(value: Column | str = "duration_ns") -> list[Column]:
    """Buckets of 8 ms. Valid durations end at 24 hours: at most ten million buckets per group and
    eight million values per bucket."""
    return bit_buckets(value, 23)


def time_buckets(value: Column | str = "start_ns") -> list[Column]:
    """Buckets of 73 minutes and of 2 ms; any BIGINT has at most two million of one in the other."""
    return bit_buckets(value, 42, 21)


def double_buckets(value: Column | str) -> list[Column]:
    """Buckets of a DOUBLE value of any size: a thousand, then a billion, per doubling."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.signum(value) * F.log2(F.lit(1.0) + F.abs(value))
    return [F.floor(scale * F.lit(float(2**b))).cast("bigint") for b in (10, 30)]


def rank_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Rank],
    carry: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
    buckets: Sequence[Column] | None = None,
) -> DataFrame:
    """One row per group with ``keys``, one column per entry of ``ranks`` and of ``carry``.

    ``carry`` adds mergeable aggregates to the first pass: name -> (aggregate over rows, merge of
    the partial results). Rows whose value is NULL are left out. ``buckets`` are from coarse to
    fine and must not decrease when the value grows. ``df`` is read once per bucket and once more.
    """
    carry = dict(carry or {})
    group = list(keys) or ["_all"]
    source = df.filter(F.col(value).isNotNull())
    if not keys:
        source = source.withColumn("_all", F.lit(0))
    buckets = list(buckets) if buckets is not None else duration_buckets(value)
    first = next(iter(ranks))

    per_bucket = source.groupBy(*group, buckets[0].alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_rows"), *[agg.alias(name) for name, (agg, _) in carry.items()]
    )
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = per_bucket.select(
        *group,
        "_bucket",
        (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(upto).alias("_upto"),
        F.sum("_rows").over(whole).alias("_n"),
        *[merge(F.col(name)).over(whole).alias(name) for name, (_, merge) in carry.items()],
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), index(F.col("_n")).alias("index"))
            for name, index in ranks.items()
        ]
    )
    held = (F.col("_index") >= F.col("_before")) & (F.col("_index") < F.col("_upto"))
    targets = staged(
        walked.withColumn("_want", F.explode(wanted))
        .select(
            *group, "_bucket", "_before", "_upto", F.col("_want.name").alias("_name"),
            F.col("_want.index").alias("_index"), *carry,
        )
        .filter(held),
        "rank-targets",
    )

    # Every further pass joins the rows with the few (group, bucket) pairs, and walks what is left.
    found = targets.select(*group, "_name", "_index", "_before", "_bucket")
    walk = [*group, "_name"]
    in_order = (
        Window.partitionBy(*walk).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for coarse, fine in zip(buckets, [*buckets[1:], F.col(value)]):
        rows = source.select(*group, coarse.alias("_bucket"), fine.alias("_finer"))
        counted = (
            join_null_safe(rows, found, [*group, "_bucket"])
            .groupBy(*walk, "_index", "_before", F.col("_finer").alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
        found = (
            counted.withColumn("_upto", F.col("_before") + F.sum("_rows").over(in_order))
            .withColumn("_before", F.col("_upto") - F.col("_rows"))
            .filter(held)
            .select(*walk, "_index", "_before", "_bucket")
        )
        if coarse is not buckets[-1]:
            found = staged(found, "rank-targets")
    result = found.groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_bucket"))).alias(name) for name in ranks]
    )
    if carry:
        carried = targets.filter(F.col("_name") == first).select(*group, *carry)
        result = join_null_safe(result, carried, group)
    return result.select(*keys, *ranks, *carry)


def approx_percentile(value: Column | str, p: float = 0.95, accuracy: int = 1000) -> Column:
    """Mergeable estimate with rank error ``1 / accuracy``."""
    return F.percentile_approx(value, p, accuracy)
