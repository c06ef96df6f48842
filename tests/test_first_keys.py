from spanloom.sources import otlp


def test_first_of_equal_keys_counts(spark):
    rows = [(1, [("k", "a"), ("l", "b")]), (2, [("k", "a"), ("k", "b"), (None, "c")]), (3, [(None, "c")]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "id int, e array<struct<key:string,value:string>>")
    found = otlp.with_first_wins(df, "e")
    got = {r.id: r.e for r in found.collect()}
    assert got == {1: {"k": "a", "l": "b"}, 2: {"k": "a"}, 3: {}, 4: None, 5: {}}
    # Keys are not listed anew for every entry.
    assert "transform(" not in found._jdf.queryExecution().executedPlan().toString()
