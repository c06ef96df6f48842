"""Window style operators W1, W3 and W4."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64, salt_on: str = "span_id"
) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    Each key is first cut down in ``salts`` parts, so the final pass sees at most ``salts * n`` rows
    of a key, however many it has.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(part))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def error_clusters(histogram: DataFrame, width: int = 5, more_than: int = 10) -> DataFrame:
    """Runs of buckets whose next ``width`` buckets hold more than ``more_than`` errors.

    Adjacent hits form one cluster, named by its first bucket. The input is one row per bucket, so
    a single window over it is bounded by the number of buckets.
    """
    last = histogram.agg(F.max("bucket")).scalar()
    line = Window.partitionBy(F.lit(0)).orderBy("bucket")
    hits = (
        histogram.withColumn("errors_ahead", F.sum("errors").over(line.rowsBetween(0, width - 1)))
        .filter((F.col("errors_ahead") > more_than) & (F.col("bucket") + width <= last))
        .withColumn("_island", F.col("bucket") - F.row_number().over(line))
    )
    return (
        hits.groupBy("_island")
        .agg(
            F.min("bucket").alias("bucket"),
            F.count(F.lit(1)).alias("buckets"),
            F.max("errors_ahead").alias("max_errors"),
        )
        .drop("_island")
    )


def traffic_spikes(histogram: DataFrame) -> DataFrame:
    """Buckets with more than twice the traces of both neighbours."""
    line = Window.partitionBy(F.lit(0)).orderBy("bucket")
    return (
        histogram.withColumns({"_before": F.lag("traces").over(line), "_after": F.lead("traces").over(line)})
        .filter((F.col("traces") > F.col("_before") * 2) & (F.col("traces") > F.col("_after") * 2))
        .select("bucket", "traces")
    )
