"""Pending traces that release their spans, and ingest that keeps every line, over several micro-batches."""

import json
from datetime import datetime, timezone

from conftest import span
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType
from test_sources import otlp_request

from spanloom import schema
from spanloom.operators import sampling
from spanloom.sources import otlp
from spanloom.streaming import jobs, pending

SECOND = 1000


def received(spark, path, *batches):
    """A stream with one micro-batch for each list of (span row, arrival in ms)."""
    kinds = StructType([*schema.SPAN, StructField("received_time", TimestampType())])
    for rows in batches:
        df = spark.createDataFrame([(*row, datetime.fromtimestamp(10_000 + at / 1000, timezone.utc)) for row, at in rows], kinds)
        df.drop("attributes", "tags", "resource_attributes").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("attributes", "tags", "resource_attributes").schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(trace, span_id, at, **kw):
    return span(trace, span_id, **kw), at


def released(df):
    return sorted((r.trace_id, r.span_id, r.reason, r.keep, r.late) for r in df.collect())


def test_spans_leave_with_one_decision(spark, tmp_path):
    """An error seen in time keeps the trace; one that comes late doesn't change the decision."""
    quiet = next(f"q{i}" for i in range(1000) if not spark.range(1).select(pending.S.hash_keep(F.lit(f"q{i}"), sampling.BASE_RATE)).first()[0])
    stream = received(
        spark, str(tmp_path / "in"),
        [plain("bad", "1", 0), plain("bad", "1", 0), plain(quiet, "3", 1000, ms=5)],
        [plain("bad", "2", 20 * SECOND, status="error"), plain("slow", "4", 25 * SECOND, ms=1001)],
        [plain("x", "9", 100 * SECOND)],
        [plain("x", "8", 101 * SECOND)],
        [plain(quiet, "5", 102 * SECOND, status="error"), plain("bad", "6", 103 * SECOND), plain("slow", "7", 103 * SECOND)],
        [plain("y", "9", 900 * SECOND)],
    )
    want = [("bad", "1", "error", True, False)] * 2 + [("bad", "2", "error", True, False), ("bad", "6", "error", True, True)]
    want += [(quiet, "3", "normal", False, False), (quiet, "5", "normal", False, True)]
    want += [("slow", "4", "slow", True, False), ("slow", "7", "slow", True, True)]
    got = [r for r in released(jobs.drained(pending.released_spans(stream, "received_time"))) if r[0] not in "xy"]
    assert got == sorted(want)


def test_wide_and_complex_traces(spark, tmp_path):
    rows = [plain("wide", str(i), 0, service=f"s{i}", ms=1) for i in range(6)]
    rows += [plain("complex", str(i), 0, service=f"s{i % 3}", ms=1) for i in range(101)]
    stream = received(spark, str(tmp_path / "in"), rows, [plain("z", "9", 100 * SECOND)], [plain("z", "8", 101 * SECOND)])
    got = jobs.drained(pending.released_spans(stream, "received_time")).groupBy("trace_id", "reason").count().collect()
    assert {tuple(r) for r in got} >= {("wide", "wide", 6), ("complex", "complex", 101)}


def test_forgotten_decisions_and_restart(spark, tmp_path):
    """State survives a restart; spans that come after the decision is forgotten begin a new trace."""
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [
        [[plain("t", "1", 0, status="error")], [plain("x", "0", 60 * SECOND)], [plain("x", "1", 61 * SECOND)]],
        [[plain("t", "2", 70 * SECOND)], [plain("x", "2", 2000 * SECOND)], [plain("x", "3", 2001 * SECOND)]],
        [[plain("t", "3", 2002 * SECOND, ms=2000)], [plain("x", "4", 2100 * SECOND)], [plain("x", "5", 2101 * SECOND)]],
    ]
    for batches in parts:
        stream = received(spark, path, *batches)
        jobs.start_append(pending.released_spans(stream, "received_time"), out, state, interval=None).awaitTermination()
    got = [r for r in released(spark.read.parquet(out)) if r[0] == "t"]
    assert got == [("t", "1", "error", True, False), ("t", "2", "error", True, True), ("t", "3", "slow", True, False)]


def test_reason_of_one_trace_is_the_rule_of_the_table(spark):
    rows = [(e, d, n, s) for e in (True, False) for d in (10**9, 10**9 + 1) for n in (100, 101) for s in (5, 6)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "trace_id string, has_error boolean, max_span_duration_ns long, span_count long, service_count long")
    decided = sampling.tail_decisions(df).withColumn("drawn", pending.S.hash_keep("trace_id", sampling.BASE_RATE)).collect()
    for r in decided:
        assert r.reason == sampling.tail_reason(r.has_error, r.max_span_duration_ns, r.span_count, r.service_count, r.drawn)


def test_every_line_is_kept_over_files_and_a_restart(spark, tmp_path):
    source, out, state = tmp_path / "lines", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    good, bad = json.dumps(otlp_request()), json.dumps(otlp_request(startTimeUnixNano="0"))
    files = [[good, "{broken", ""], [bad, "[1, 2]", good], [good, "null", bad, "text"]]
    for k, lines in enumerate(files):
        (source / f"{k}.json").write_text("\n".join(lines))
        stream = otlp.read_lines(spark, str(source), stream=True, max_files=1)
        jobs.start_line_ingest(stream, out, state, interval=None).awaitTermination()
    rows = {n: spark.read.parquet(f"{out}/{n}") for n in ("spans", "rejected", "malformed")}
    assert {n: df.count() for n, df in rows.items()} == {"spans": 3, "rejected": 2, "malformed": 4}
    assert sorted(r.line for r in rows["malformed"].collect()) == ["[1, 2]", "null", "text", "{broken"]
    assert {r.reject_reason for r in rows["malformed"].collect()} == {"malformed_request"}
    assert rows["spans"].select("batch").distinct().count() == 3


def test_head_sampled_spans_are_set_apart(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(otlp_request(traceId=f"{i:032x}")) for i in range(1, 60)))
    stream = otlp.read_lines(spark, str(source), stream=True)
    jobs.start_line_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), head_rate=5000, interval=None).awaitTermination()
    kept, gone = (spark.read.parquet(str(tmp_path / "out" / n)).count() for n in ("spans", "unsampled"))
    assert kept + gone == 59 and 10 < kept < 50
