import random

from conftest import MS, span

from pyspark.sql import functions as F
from spanloom.functions import quantile as Q
from spanloom.operators import retention, tree, windows
from spanloom.operators.ranked import look_back, prefix_sums, ranked


def skewed(spark, n=400):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(100)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i long, v long").repartition(7)


def test_prefix_sums_over_a_hot_key(spark):
    rows, df = skewed(spark)
    got = {r.i: r for r in prefix_sums(df, ["k"], ["i"], {"upto": F.col("v")}).collect()}
    for key in {k for k, _, _ in rows}:
        total = 0
        group = sorted((i, v) for k, i, v in rows if k == key)
        for i, v in group:
            total += v
            assert got[i].upto == total
        assert {got[i].upto_total for i, _ in group} == {total}


def test_missing_keys_are_groups_too(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", 100 + i) for i in range(3)], "k string, v long")
    rows = ranked(df, ["k"], ["v"]).collect()
    assert sorted(r.row_number for r in rows if r.k is None) == list(range(1, 31)) and len(rows) == 33
    got = {r.k: (r.p50, r.n) for r in Q.rank_quantiles(df, ["k"], "v", {"p50": Q.percent_index(50)}, {"n": (F.count(F.lit(1)), F.sum)}).collect()}
    assert got == {None: (15, 30), "a": (101, 3)}


def test_global_row_numbers(spark):
    rows, df = skewed(spark)
    got = ranked(df, [], [F.desc("v"), F.col("i")]).orderBy("row_number").collect()
    want = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [r.i for r in got] == [r[1] for r in want]
    assert [r.row_number for r in got] == list(range(1, len(rows) + 1)) and got[0].group_rows == len(rows)


def test_look_back_across_chunks(spark):
    rows, df = skewed(spark)
    out = look_back(df, ["k"], ["i"], 10, {"s": F.col("v")}, {"before": F.col("i")}, chunk_rows=16)
    got = {r.i: r for r in out.collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        group = sorted((i, v) for k, i, v in rows if k == key)
        for at, (i, _) in enumerate(group):
            frame = group[max(0, at - 10) : at]
            assert got[i].s == sum(v for _, v in frame) and got[i].seen == len(frame)
            assert got[i].before == (group[at - 1][0] if at else None)


def test_newest_per_key(spark):
    rows, df = skewed(spark)
    got = windows.newest_per_key(df, ["k"], [F.desc("i")], 5, salts=3, salt_on="i").collect()
    for key in {k for k, _, _ in rows}:
        want = sorted((i for k, i, _ in rows if k == key), reverse=True)[:5]
        assert sorted((r.i for r in got if r.k == key), reverse=True) == want


def test_depths_of_a_long_chain_and_a_cycle(make_spans):
    rows = [span("t", f"n{i}", f"n{i - 1}" if i else None, start_ms=i) for i in range(70)]
    rows += [span("t", "x", "y"), span("t", "y", "x"), span("t", "z", "y"), span("t", "o", "missing")]
    depth = {r.span_id: (r.depth, r.under_root) for r in tree.span_tree(make_spans(*rows)).collect()}
    assert all(depth[f"n{i}"] == (i, True) for i in range(70))
    assert depth["o"] == (0, False)
    assert {depth[s][0] for s in "xyz"} == {None}


def test_preorder_children_by_start(make_spans):
    rows = [
        span("t", "root"), span("t", "late", "root", start_ms=9), span("t", "early", "root", start_ms=2),
        span("t", "leaf", "early", start_ms=50), span("t", "orphan", "gone"),
    ]
    ordered = tree.preorder(make_spans(*rows)).orderBy("trace_id", "sort_key").collect()
    assert [(r.span_id, r.level) for r in ordered] == [("root", 0), ("early", 1), ("leaf", 2), ("late", 1)]
    assert tree.preorder(make_spans(*rows), orphans=True).count() == 5


def plain_tour(rows, orphans=False):
    """Positions by a walk over every trace."""
    out, below = {}, {}
    ids = {(r[0], r[1]) for r in rows}
    for r in rows:
        up = r[2] if (r[0], r[2]) in ids or r[2] is None else None if orphans else "?"
        below.setdefault((r[0], up), []).append((r[5], r[1]))
    for trace in {r[0] for r in rows}:
        stack, at = [(n, 0) for n in sorted(below.get((trace, None), []), reverse=True)], 0
        order = []
        while stack:
            (_, name), level = stack.pop()
            order.append((name, level, at))
            at += 1
            stack += [(n, level + 1) for n in sorted(below.get((trace, name), []), reverse=True)]
        for k, (name, level, pos) in enumerate(order):
            size = next((j for j in range(k + 1, len(order)) if order[j][1] <= level), len(order)) - k
            out[trace, name] = (level, pos, size)
    return out


def test_tour_of_a_deep_chain_a_wide_span_cycles_and_orphans(make_spans):
    rows = [span("chain", f"n{i:05d}", f"n{i - 1:05d}" if i else None, start_ms=i) for i in range(10_000)]
    rows += [span("wide", "top")] + [span("wide", f"c{i}", "top", start_ms=(i * 7919) % 500) for i in range(500)]
    rows += [span("odd", "r1"), span("odd", "r2", start_ms=5), span("odd", "a", "r1"), span("odd", "b", "a"), span("odd", "lost", "gone"), span("odd", "under", "lost")]
    rows += [span("odd", "x", "y"), span("odd", "y", "x"), span("odd", "z", "y"), span("one", "only")]
    df = make_spans(*rows)
    for orphans in (False, True):
        got = {(r.trace_id, r.span_id): (r.level, r.position, r.subtree) for r in tree.tour_positions(df, orphans).collect()}
        assert got == plain_tour(rows, orphans)
    assert tree.tour_positions(df.limit(0)).count() == 0


def test_self_time_may_be_negative(make_spans):
    rows = [span("t", "p", ms=100), span("t", "a", "p", ms=80), span("t", "b", "p", ms=70)]
    got = {r.span_id: r.self_ns for r in tree.self_times(make_spans(*rows)).collect()}
    assert got == {"p": -50 * MS, "a": 80 * MS, "b": 70 * MS}


def test_histogram_and_its_annotations(spark):
    hist = spark.createDataFrame(
        [(i, 10 if i != 20 else 50, 4 if 5 <= i <= 8 else 0) for i in range(30)], "bucket int, traces long, errors long"
    )
    assert [r.bucket for r in windows.traffic_spikes(hist).collect()] == [20]
    clusters = windows.error_clusters(hist).collect()
    assert [(r.bucket, r.buckets) for r in clusters] == [(3, 4)]


def test_keep_newest_fills_up_ties(make_spans):
    rows = [span("t", f"s{i:02d}", start_ms=i // 4) for i in range(20)]
    kept = retention.keep_newest(make_spans(*rows), 10).collect()
    assert sorted(r.span_id for r in kept) == ["s08", "s09"] + [f"s{i}" for i in range(12, 20)]
    assert retention.keep_newest(make_spans(*rows), 100).count() == 20
    assert retention.evict(make_spans(*rows), 20, 20).count() == 16
    assert retention.evict(make_spans(*rows), 20, 1000).count() == 20
