"""Leaves of small traces are told inside their row, with the results of a join."""

from test_small_traces import both, rows

from spanloom.operators import graph, tree


def test_leaves_agree(spark, monkeypatch):
    few, joined = both(monkeypatch, lambda: sorted(map(str, tree.span_tree(rows(spark), labels="span_id", leaves=True).collect())))
    assert few == joined and any("span_id='z'" in r for r in few) and not any("span_id='x'" in r for r in few)


def test_call_paths_join_no_parents(spark):
    unique = rows(spark).filter("trace_id <> 'd'").selectExpr("*", "span_id as service_name")
    plan = graph.call_paths(unique)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
