from pyspark.sql import functions as F

from spanloom.operators import metrics


def _points(spark, count=40_000):
    """Values 1001 to 1000 + count in one window, in no order, and one NaN."""
    value = (F.col("id") * 7919 % count + 1001).cast("double")
    rows = spark.range(count).select(F.lit(0).cast("bigint").alias("ts_ns"), F.lit("a").alias("service_name"), F.lit("m").alias("metric_name"), value.alias("value"))
    return metrics.with_event_time(rows)


def test_window_percentile_is_exact_for_many_values(spark):
    row = metrics.minute_windows(_points(spark)).first()
    assert (row.p95, row.latency_count) == (1000 + 38_000, 40_000)


def test_series_percentile_is_exact_for_many_values(spark):
    series = metrics.time_series(_points(spark), "1 day", "percentile")
    assert [(r.points, r.value) for r in series.collect()] == [(40_000, 39_000.0)]
