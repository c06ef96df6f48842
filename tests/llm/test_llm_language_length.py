"""The margin of a clear language must not fall with the length of a text."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import language_id


@pytest.mark.parametrize("lang", ["de", "es"])
def test_long_texts_stay_clear(spark, lang):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = language_id.fit(documents.where(~language_id.held_out(F.col("doc_id"))))
    words = " ".join(r.text for r in documents.where((F.col("lang") == lang) & language_id.held_out(F.col("doc_id"))).orderBy("doc_id").collect()).split()
    rng, texts = random.Random(1), []
    for size in (20_000, 1_000_000, 12_000_000):
        text = ""
        while len(text) < size:
            rng.shuffle(words)
            text += " " + " ".join(words)
        texts.append(text[:size])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3, "doc_id")
    got = language_id.predict(df, dictionaries).select("lang_pred", "rejected").collect()
    assert [tuple(r) for r in got] == [(lang, False)] * 3
    sizes = language_id.sizes([language_id.words_only(t) for t in texts[:2]], dictionaries)
    margins = [(sorted(s)[1] - min(s)) / min(s) for s in sizes.tolist()]
    assert margins[1] > 0.5 * margins[0] > 0.01


def test_dictionary_is_filled_from_a_few_long_texts(spark):
    """Three texts of 300 kB fill the dictionary, and a piece need not be the head of its text."""
    texts = [" ".join(f"{'abcdefghij'[k]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(60_000)) for k in range(3)]
    df = spark.createDataFrame([(t, "xx") for t in texts] + [("short text", "yy"), ("123", "zz")], "text string, lang string")
    got = language_id.fit(df)
    parts = got["xx"].split(b"\n")
    assert sum(map(len, parts)) == language_id.DICTIONARY_BYTES
    assert all(any(p.decode() in t for t in texts) for p in parts) and not all(any(t.startswith(p.decode()) for t in texts) for p in parts)
    assert got["yy"] == b"short text" and got == language_id.fit(df.repartition(3))
