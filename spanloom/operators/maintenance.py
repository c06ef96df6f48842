"""B8, X1, X6 on written span tables: expiry of whole partitions, compaction, one maintenance run.

A table is a folder of Parquet files partitioned by ``dt``, a time key of the start (see
:func:`export.partition_key`). Only partitions that change are written again, and whole ones are removed
without being read.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import retention
from spanloom.session import staged

#: Bytes of a file after compaction.
TARGET_BYTES = 128 << 20
_KEYS = {"hour": "%Y%m%d_%H", "day": "%Y%m%d", "week": "%GW%V", "month": "%Y%m"}


def time_key(ns: int, unit: str) -> str:
    """The partition key of a moment."""
    return datetime.fromtimestamp(ns // S.NS_PER_SEC, timezone.utc).strftime(_KEYS[unit])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table with ``dt`` as a text, whatever its keys look like."""
    schema = spark.read.parquet(path).drop("dt").schema.add("dt", "string")
    return spark.read.schema(schema).parquet(path)


def partition_files(spark: SparkSession, path: str) -> DataFrame:
    """``(dt, files, bytes)`` of every partition, from the listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_extract("path", "/dt=([^/]+)/", 1)
    return listed.select(key.alias("dt"), "length").groupBy("dt").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def _planned(files: DataFrame, target_bytes: int) -> DataFrame:
    """Adds ``wanted``, the number of files that hold a partition's bytes at the target size."""
    return files.withColumn("wanted", F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1)).cast("bigint"))


def _replace(rows: DataFrame, wanted: DataFrame, path: str) -> None:
    """Puts ``rows`` in place of the partitions they are of, in the ``wanted`` number of files each.

    They are written aside first: the old files are removed only once the new rows are safe. Rows of a
    partition are dealt by trace, so files come out even and none is a task of its own.
    """
    file = F.pmod(F.xxhash64("trace_id"), F.col("wanted"))
    dealt = rows.join(F.broadcast(wanted.select("dt", "wanted")), "dt").withColumn("_file", file).drop("wanted")
    safe = staged(dealt, "replaced-partitions")
    (
        safe.repartition("dt", "_file").sortWithinPartitions("dt", "service_name", "start_ns").drop("_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    )


def _remove(spark: SparkSession, path: str, days: list[str]) -> None:
    for day in days:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def compact(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> list[str]:
    """Packs the files of partitions that have more of them than their bytes need; returns their keys."""
    plan = staged(_planned(partition_files(spark, path), target_bytes).filter("files > wanted"), "compaction")
    days = sorted(r.dt for r in plan.select("dt").collect())
    if days:
        _replace(read_table(spark, path).join(F.broadcast(plan.select("dt")), "dt", "left_semi"), plan, path)
    return days


def expire_table(spark: SparkSession, path: str, as_of_ns: int, retention_ns: int, unit: str = "day", target_bytes: int = TARGET_BYTES) -> list[str]:
    """Removes spans that started before the retention period; returns the keys that went whole.

    Partitions before the oldest moment's go without being read, the one that holds it is written again.
    """
    oldest = as_of_ns - retention_ns
    edge = time_key(oldest, unit)
    plan = staged(_planned(partition_files(spark, path), target_bytes), "partitions")
    at_edge = read_table(spark, path).filter(F.col("dt") == edge)
    stays, goes = F.col("start_ns") >= oldest, F.col("start_ns") < oldest
    gone = sorted(r.dt for r in plan.filter(F.col("dt") < edge).select("dt").collect())
    if not at_edge.filter(goes).isEmpty():
        if at_edge.filter(stays).isEmpty():
            gone.append(edge)
        else:
            _replace(at_edge.filter(stays), plan.filter(F.col("dt") == edge), path)
    _remove(spark, path, gone)
    return gone


def maintain_table(
    spark: SparkSession,
    path: str,
    as_of_ns: int,
    max_spans: int,
    retention_ns: int = retention.RETENTION_NS,
    idle_after_ns: int = retention.IDLE_AFTER_NS,
    unit: str = "day",
    target_bytes: int = TARGET_BYTES,
) -> DataFrame:
    """Compact, expire, drop incomplete, drop idle and cap in one run; returns what was done to each partition.

    The steps are tests on the rows; ids and numbers are found from a few columns. Each partition is then
    compared by its number of rows: those that lose some, or have too many files, are written again
    once, empty ones are removed, all others are left alone.
    """
    plan = _planned(partition_files(spark, path), target_bytes)
    table = read_table(spark, path)
    live = table.filter(F.col("dt") >= time_key(as_of_ns - retention_ns, unit))
    kept = retention.expire(live, as_of_ns, retention_ns)
    kept = retention.drop_incomplete(kept, as_of_ns)
    kept = retention.drop_idle(kept, as_of_ns, idle_after_ns)
    kept = retention.keep_newest(kept, max_spans)
    before = table.groupBy("dt").agg(F.count(F.lit(1)).alias("rows_before"))
    after = kept.groupBy("dt").agg(F.count(F.lit(1)).alias("rows_after"))
    rows_after = F.coalesce("rows_after", F.lit(0).cast("bigint"))
    action = (
        F.when(F.col("rows_after") == 0, "removed")
        .when(F.col("rows_after") < F.col("rows_before"), "cut")
        .when(F.col("files") > F.col("wanted"), "compacted")
        .otherwise("kept")
    )
    done = before.join(after, "dt", "left").withColumn("rows_after", rows_after).join(plan, "dt").withColumn("action", action)
    done = staged(done, "maintenance")
    changed = done.filter(F.col("action").isin("cut", "compacted"))
    if not changed.isEmpty():
        _replace(kept.join(F.broadcast(changed.select("dt")), "dt", "left_semi"), changed, path)
    _remove(spark, path, [r.dt for r in done.filter("action = 'removed'").select("dt").collect()])
    return done.select("dt", "action", "rows_before", "rows_after", "files", "wanted")
