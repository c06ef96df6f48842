"""Written span tables: compaction, expiry of whole partitions, one maintenance run."""

from pathlib import Path

import pytest
from conftest import BASE_NS, span

from spanloom.operators import maintenance, retention
from spanloom.sources import export

DAY = 86_400_000
NS = 10**6


@pytest.fixture
def table(make_spans, tmp_path):
    """Ten days of spans, written in four turns of several files."""
    rows = [span(f"t{i}", f"{k}", None if k == 0 else "0", f"s{k}", "op", -(i % 10) * DAY + k) for i in range(40) for k in range(3)]
    rows += [span(f"single{i}", "0", None, "s0", "op", -i * DAY - 1000) for i in range(10)]
    rows += [span("idle", str(k), None, "forgotten", "op", -5 * DAY + k) for k in range(4)]
    df, path = make_spans(*rows).drop("attributes", "tags", "resource_attributes"), str(tmp_path / "table")
    for k in range(4):
        export.write_spans(df.filter(f"pmod(xxhash64(trace_id, span_id), 4) = {k}"), path, files_per_key=3)
    return df, path


def files(path):
    return {d.name[3:]: sorted(f.name for f in d.glob("*.parquet")) for d in Path(path).glob("dt=*")}


def ids(df):
    return sorted((r.trace_id, r.span_id) for r in df.select("trace_id", "span_id").collect())


def test_compaction_packs_files_and_keeps_rows(spark, table):
    df, path = table
    before = files(path)
    assert all(len(f) > 1 for f in before.values())
    assert maintenance.compact(spark, path) == sorted(before)
    packed = files(path)
    assert all(len(f) == 1 for f in packed.values()) and ids(maintenance.read_table(spark, path)) == ids(df)
    assert maintenance.compact(spark, path) == [] and files(path) == packed


def test_a_busy_day_gets_several_files(spark, table):
    df, path = table
    size = max(r.bytes for r in maintenance.partition_files(spark, path).collect())
    # Rows this small would all be dealt to one task again.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "97"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        maintenance.compact(spark, path, target_bytes=size // 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    counts = [len(f) for f in files(path).values()]
    assert max(counts) <= 4 and sum(counts) >= 15 and ids(maintenance.read_table(spark, path)) == ids(df)


def test_expiry_removes_whole_days_and_cuts_one(spark, table):
    df, path = table
    before = files(path)
    as_of, keep = BASE_NS + NS, 4 * DAY * NS
    gone = maintenance.expire_table(spark, path, as_of, keep)
    edge = maintenance.time_key(as_of - keep, "day")
    assert gone and all(d < edge for d in gone) and set(files(path)) == set(before) - set(gone)
    assert ids(maintenance.read_table(spark, path)) == ids(retention.expire(df, as_of, keep))
    after = files(path)
    assert all(after[d] == before[d] for d in after if d > edge) and after[edge] != before[edge]
    assert maintenance.expire_table(spark, path, as_of, keep) == [] and files(path) == after


def test_one_run_equals_the_steps(spark, table):
    df, path = table
    maintenance.compact(spark, path)
    before = files(path)
    args = (BASE_NS + DAY * NS, 70, 8 * DAY * NS, 2 * DAY * NS)
    done = {r.dt: r for r in maintenance.maintain_table(spark, path, *args).collect()}
    assert ids(maintenance.read_table(spark, path)) == ids(retention.maintain(df, *args))
    after = files(path)
    assert {r.action for r in done.values()} >= {"removed", "cut"}
    for day, r in done.items():
        assert (day in after) == (r.action != "removed")
        if r.action == "kept":
            assert after[day] == before[day]
    again = maintenance.maintain_table(spark, path, *args).collect()
    assert {r.action for r in again} == {"kept"} and files(path) == after


@pytest.mark.parametrize("unit,key", [("hour", "20231114_22"), ("day", "20231114"), ("week", "2023W46"), ("month", "202311")])
def test_keys_agree_with_those_of_the_writer(spark, make_spans, unit, key):
    assert maintenance.time_key(BASE_NS, unit) == key
    assert make_spans(span("t", "1")).select(export.partition_key(unit)).first()[0] == key


def test_tiers_are_read_back(spark, make_spans, tmp_path):
    df = make_spans(*[span("t", str(i), start_ms=-i * 60_000) for i in range(10)]).drop("attributes", "tags", "resource_attributes")
    export.write_tiers(df, str(tmp_path), BASE_NS, files_per_key=1)
    parts = {n: maintenance.read_table(spark, str(tmp_path / n)) for n in ("hot", "cold")}
    assert (parts["hot"].count(), parts["cold"].count()) == (6, 4)
