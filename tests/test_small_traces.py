"""Small traces are walked inside their row, with the results of the joins."""

from spanloom.operators import tree

SCHEMA = "trace_id string, span_id string, parent_span_id string, start_ns bigint"


def rows(spark):
    small = [("a", "r", None, 5), ("a", "c2", "r", 7), ("a", "c1", "r", 7), ("a", "g", "c1", 1), ("a", "lost", "none", 2), ("a", "under", "lost", 3)]
    cycle = [("b", "x", "y", 1), ("b", "y", "x", 2), ("b", "z", "x", 3), ("b", "r", None, 4)]
    chain = [("c", "0", None, 0)] + [("c", str(i), str(i - 1), -i) for i in range(1, 40)]
    twice = [("d", "r", None, 1), ("d", "p", "r", 2), ("d", "p", "r", 3), ("d", "q", "p", 4)]
    return spark.createDataFrame([*small, *cycle, *chain, *twice, ("e", "one", None, 9)], SCHEMA)


def both(monkeypatch, results):
    few = results()
    monkeypatch.setattr(tree, "SMALL_TRACE", 0)
    return few, results()


def test_trees_agree(spark, monkeypatch):
    def results():
        return sorted(map(str, tree.span_tree(rows(spark), labels="span_id").collect()))

    few, joined = both(monkeypatch, results)
    assert few == joined and len(few) == 6 + 4 + 40 + 5 + 1


def test_positions_agree(spark, monkeypatch):
    def results():
        unique = rows(spark).filter("trace_id <> 'd'")
        return [sorted(map(str, tree.tour_positions(unique, o).collect())) for o in (False, True)]

    few, joined = both(monkeypatch, results)
    assert few == joined


def test_small_traces_take_no_joins(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(tree, "_joined_tree", fail)
    monkeypatch.setattr(tree, "_joined_positions", fail)
    unique = rows(spark).filter("trace_id <> 'd'")
    assert tree.span_tree(unique).count() == 51
    assert tree.tour_positions(unique).count() == 4 + 1 + 40 + 1
