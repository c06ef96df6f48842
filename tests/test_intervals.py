"""Points in intervals against plain loops, with hot keys, ties, nulls and empty sides."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.operators import logs

POINT, SPAN = "k string, at long, v long, w double", "id long, k string, a long, b long"


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(4)
    points = [(r.choice("hhhhhhhhhab"), r.choice([500, r.randrange(1000)]), r.randrange(9), r.random()) for _ in range(600)]
    points += [(None, 5, 1, 1.0), ("a", None, 1, 1.0), ("a", 7, None, None)]
    spans = [(i, r.choice("hhhabc"), a := r.randrange(1000), a + r.choice([-1, 0, 3, 50, 2000])) for i in range(120)]
    spans += [(200, "h", 500, 500), (201, None, 0, 9), (202, "h", None, 9), (203, "h", 0, None), (204, "h", 0, 10**6)]
    return points, spans, spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN)


def held(points, spans):
    for i, k, a, b in spans:
        if None not in (k, a, b):
            for p in points:
                if p[0] == k and p[1] is not None and a <= p[1] <= b:
                    yield (i, k, a, b), p


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_rows_and_totals(spark, sides, parts):
    points, spans, p, s = sides
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [tuple(r) for r in I.interval_rows(p, s, ["k"], "at", ("a", "b")).collect()]
        totals = I.interval_totals(p, s, ["k"], "at", {"n": F.lit(1).cast("bigint"), "v": F.col("v"), "w": F.col("w")}, ["id"], ("a", "b")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(*i, *q[1:]) for i, q in held(points, spans)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    sums = {}
    for (i, *_), (_, at, v, w) in held(points, spans):
        sums.setdefault(i, []).append((at, v or 0, w or 0.0))
    assert {r.id for r in totals} == set(sums)
    for r in totals:
        own = sums[r.id]
        assert (r.n, r.v, r.first_at, r.last_at) == (len(own), sum(x[1] for x in own), min(own)[0], max(own)[0])
        assert r.w == pytest.approx(sum(x[2] for x in own))


def test_no_points_and_no_intervals(sides):
    _, _, p, s = sides
    assert I.interval_rows(p.limit(0), s, ["k"], "at", ("a", "b")).count() == 0
    assert I.interval_rows(p, s.limit(0), ["k"], "at", ("a", "b")).count() == 0
    assert I.interval_totals(p.limit(0), s, ["k"], "at", {"v": F.col("v")}, ["id"], ("a", "b")).count() == 0
    with pytest.raises(ValueError):
        I.interval_rows(p.withColumn("id", F.lit(1)), s, ["k"], "at", ("a", "b"))


def test_trace_context(spark):
    summary = spark.createDataFrame([("t", 100, 200, ["a", "b"]), ("u", 0, 10, ["a"])], "trace_id string, start_ns long, end_ns long, services array<string>")
    log_rows = spark.createDataFrame([("a", 95, "ERROR", "x"), ("b", 200, "INFO", "y"), ("c", 150, "INFO", "z"), ("a", 206, "INFO", "w")], "service_name string, ts_ns long, severity string, body string")
    points = spark.createDataFrame([("b", 150, "cpu", 0.5), ("b", 151, "cpu", 2.0)], "service_name string, ts_ns long, metric_name string, value double")
    got = {r.trace_id: r for r in logs.trace_context(summary, log_rows, points, 5).collect()}
    t, u = got["t"], got["u"]
    assert (t.logs, t.log_errors, t.points, t.value_sum, t.context_start_ns, t.context_end_ns) == (2, 1, 2, 2.5, 95, 200)
    assert (u.logs, u.log_errors, u.points, u.value_sum, u.context_start_ns) == (0, 0, 0, 0.0, None)
    rows = logs.context_rows(summary, log_rows, points, 5).collect()
    assert sorted((r.trace_id, r.signal, r.ts_ns) for r in rows) == [("t", "log", 95), ("t", "log", 200), ("t", "metric", 150), ("t", "metric", 151)]
