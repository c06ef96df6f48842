"""Global order without a single task: row numbers, running sums and long look-backs.

A range partition on the full sort key splits the rows evenly whatever the keys look like. The
range number is written with the rows, so it is fixed from then on; a small table with the totals of the
groups that cross a range border then gives each range its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.joins import join_null_safe
from spanloom.session import staged


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    measures: dict[str, Column],
) -> DataFrame:
    """Running sums of ``measures`` per group in ``order``, and the group totals.

    Adds ``<name>`` (inclusive running sum) and ``<name>_total`` per measure. ``order`` must tell
    rows of a group apart. Any number of groups, any group size: rows of a group may span ranges.
    """
    keys = list(keys)
    names = list(measures)
    order = _columns(order)
    columns = df.columns
    if not keys:
        keys = ["_all"]
        df = df.withColumn("_all", F.lit(0))
    cut = (
        df.withColumns({f"_m_{n}": c for n, c in measures.items()})
        .repartitionByRange(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    cut = staged(cut, "ranges")

    # Only the first and the last group of a range can reach into another range, so offsets are
    # needed for at most two groups per range.
    edge = F.struct(*keys)
    edges = (
        cut.groupBy("_range")
        .agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
        .select(F.explode(F.array("low", "high")).alias("edge"))
        .select("edge.*")
        .distinct()
    )
    edges = staged(edges, "range-edges")
    slim = cut.select("_range", *keys, *[f"_m_{n}" for n in names])
    totals = (
        join_null_safe(slim, edges, keys, "left_semi")
        .groupBy("_range", *keys)
        .agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in names])
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_w_{n}") for n in names],
    )
    offsets = staged(offsets, "range-offsets")

    part = Window.partitionBy("_range", *keys)
    upto = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumns(
        {f"_s_{n}": F.sum(f"_m_{n}").over(upto) for n in names}
        | {f"_p_{n}": F.sum(f"_m_{n}").over(part) for n in names}
    )
    return join_null_safe(summed, offsets, ["_range", *keys], "left").select(
        *columns,
        *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in names],
        *[F.coalesce(F.col(f"_w_{n}"), F.col(f"_p_{n}")).alias(f"{n}_total") for n in names],
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Adds the 1-based ``row_number`` in ``order`` per group and the ``group_rows``."""
    counted = prefix_sums(df, keys, order, {"row_number": F.lit(1).cast("bigint")})
    return counted.withColumnRenamed("row_number_total", "group_rows")


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    rows: int,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    chunk_rows: int = 20_000,
) -> DataFrame:
    """Sums over the ``rows`` rows before each row of its group, and values of the row before it.

    Groups are cut into chunks of ``chunk_rows`` rows by row number; each chunk also gets a copy of
    the ``rows`` rows before it, so every frame is complete and no task sees more than one chunk.
    A sum is the difference of two running sums, which costs the same for any ``rows``; measures
    must be of an exact type. Adds ``seen``, the number of rows in the frame.
    """
    if chunk_rows < rows:
        raise ValueError("chunk_rows must be at least rows")
    sums, previous = sums or {}, previous or {}
    numbered = ranked(df, keys, order)
    position = F.col("row_number") - 1
    chunk = F.call_function("div", position, F.lit(chunk_rows).cast("bigint"))
    feeds_next = position % chunk_rows >= chunk_rows - rows
    targets = F.when(feeds_next, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    copies = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(targets))
    line = Window.partitionBy(*keys, "_chunk").orderBy("row_number")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    running = copies.withColumns(
        {f"_b_{n}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}
        | {n: F.lag(c).over(line) for n, c in previous.items()}
    )
    framed = running.withColumns(
        {n: F.col(f"_b_{n}") - F.coalesce(F.lag(f"_b_{n}", rows).over(line), F.lit(0)) for n in sums}
    )
    return (
        framed.filter(F.col("_home") == F.col("_chunk"))
        .withColumn("seen", F.least(position, F.lit(rows).cast("bigint")))
        .drop("_home", "_chunk", "group_rows", "row_number", *[f"_b_{n}" for n in sums])
    )
