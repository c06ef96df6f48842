"""Near-duplicate removal by shingles of a chosen number of words."""

from spanloom.llm import minhash


def test_keep_first_with_five_words(spark):
    words = [f"w{k}" for k in range(400)]
    edited = [f"x{k}" if k % 20 == 10 else w for k, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join([*words, "end"]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = {size: {r.doc_id for r in minhash.keep_first(df, size=size).collect()} for size in (2, 5)}
    assert kept == {2: {1}, 5: {1, 2}}
