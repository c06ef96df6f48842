"""The word model of op8 against a plain version."""

import math
from collections import Counter

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ngram_score, queries


def plain_scores(docs, target, weight=ngram_score.BACKOFF):
    words = [(i, brute.space_words((t or "").translate(brute.LOWER))) for i, t in docs]
    vocabulary = {x for _, w in words for x in w}
    models = []
    for chosen in (target, None):
        own = [w for i, w in words if w and (chosen is None or i in chosen)]
        c1 = Counter(x for w in own for x in w)
        models.append((c1, c1 + Counter({None: len(own)}), Counter(p for w in own for p in zip([None, *w], w)), c1.total()))
    out = []
    for i, w in words:
        losses = []
        for c1, context, c2, total in models:
            loss = 0.0
            for a, b in zip([None, *w], w):
                p1 = (c1[b] + weight / len(vocabulary)) / (total + weight)
                loss -= math.log((c2[a, b] + weight * p1) / (context[a] + weight))
            losses.append(loss / len(w) if w else None)
        out.append((i, len(w), *losses, losses[0] - losses[1] if w else None))
    return out


@pytest.mark.parametrize("chunk, buckets", [(ngram_score.CHUNK_BYTES, 256), (300, 3), (1, 2000)])
def test_word_scores(spark, monkeypatch, chunk, buckets):
    monkeypatch.setattr(ngram_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ngram_score, "LEAST_BUCKETS", buckets)
    docs = [(i, f"Clean plain  prose number {i % 7} for\n readers of prose number {i}") for i in range(25)]
    docs += [(100 + i, f"zxq qqz {i} xkcd zzt") for i in range(20)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "plain prose"), (203, "plain prose"), (None, "xkcd É é zzt"), (204, "x")]
    target = {*range(0, 25, 2), 203, 999}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("target", F.lit(0)).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in target] + [(101, 0), (None, 1)], "doc_id bigint, quality int")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in ngram_score.quality_report(df, labels).collect()), key=key)
    want = sorted(plain_scores(docs, target), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == (pytest.approx(w[2:]) if w[1] else (None, None, None))


def test_word_scores_without_rows_or_target(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert ngram_score.quality_report(df.limit(0), none).count() == 0
    got = {r.doc_id: r for r in ngram_score.quality_report(df, none).collect()}
    assert got[1].target_loss == pytest.approx(math.log(2)) and got[2].score is None
    assert {r.n_tokens for r in ngram_score.quality_report(df.where("doc_id = 2"), none).collect()} == {0}


def test_query_tells_word_orders_apart(spark, tmp_path):
    """Same letters and words, other order of words: byte trigrams see next to nothing of it."""
    texts = [f"w{i % 50:03d} w{(i * 7 + 1) % 50:03d}" for i in range(100)]
    spark.createDataFrame([*enumerate(texts), (500, "w001 w008"), (501, "w008 w001")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op8_lm_score(spark, str(tmp_path)).collect()}
    assert got[500].n_tokens == 2 and got[500].target_loss < got[501].target_loss
