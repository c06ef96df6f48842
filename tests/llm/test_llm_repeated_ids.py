"""Rows that share an id have texts of their own in the filters, and none is lost or changed by another's."""

import llm_brute as brute
import pytest
from test_llm_operators import DOCS, ITEMS, PASSAGE, prose

from spanloom.llm import decontamination, minhash, substring_dedup


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row int").repartition(3)


SHARED = prose(80, 50)


def test_repeats_of_each_row(spark):
    rows = [(1, f"aaa {SHARED}"), (1, "zzz another text entirely"), (1, None), (0, SHARED), (1, f"aaa {SHARED}"), (2, f"{SHARED} b"), (2, f"c {SHARED}"), (None, SHARED), (1, "")]
    got = {r.row: r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {0: "aaa", 1: rows[1][1], 2: None, 3: SHARED, 4: "aaa", 5: "b", 6: "c", 7: SHARED, 8: ""}


def test_rows_of_one_id_are_no_smaller_documents(spark):
    rows = [(1, f"aaa {SHARED}"), (1, f"bbb {SHARED}"), (1, f"ccc {SHARED} ddd"), (3, f"eee {SHARED}")]
    got = {r.row: r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: rows[1][1], 2: rows[2][1], 3: "eee"}


def test_contaminated_rows_go_and_clean_ones_stay(spark):
    rows = [(1, "aaa clean"), (1, f"zzz {ITEMS[0][1]}"), (1, None), (2, ITEMS[0][1]), (2, ITEMS[0][1]), (2, "x"), (None, ITEMS[0][1])]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.drop_contaminated(frame(spark, rows), items)
    assert got.columns == ["doc_id", "text", "row"] and {r.row for r in got.collect()} == {0, 2, 5, 6}


def test_first_of_each_group_by_row(spark):
    rows = [(1, None), (1, PASSAGE), (0, PASSAGE), (1, "word"), (2, PASSAGE + " x"), (2, prose(40, 51)), (0, PASSAGE + " y"), (None, PASSAGE), (1, PASSAGE)]
    got = minhash.keep_first(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "row"] and {r.row for r in got.collect()} == {0, 2, 3, 5, 6, 7}


@pytest.mark.parametrize("ids", [1, 4])
def test_all_texts_under_few_ids(spark, ids):
    """With ids that order the rows, every row is treated as if its id were its own."""
    rows = [(k * ids // len(DOCS), t) for k, (_, t) in enumerate(DOCS)]
    out = {r.row: r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    words = [brute.space_words(t) for _, t in rows]
    for k, w in enumerate(words):
        earlier = {tuple(words[j][p : p + 50]) for j in range(len(rows)) if rows[j][0] < rows[k][0] for p in range(len(words[j]) - 49)}
        gone = {p + x for p in range(len(w) - 49) if tuple(w[p : p + 50]) in earlier for x in range(50)}
        assert out[k] == (" ".join(x for p, x in enumerate(w) if p not in gone) if gone else rows[k][1])
