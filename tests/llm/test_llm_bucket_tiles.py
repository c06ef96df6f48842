"""Buckets that are cut into tiles, groups of near copies of which many are no links, and recall on a table."""

import random

import llm_brute as brute
import pytest

from spanloom.llm import minhash


def family(size, seed, words=120):
    """Near copies of one text at many distances around the limit, their ids in no order."""
    r = random.Random(seed)
    base = [f"w{seed}_{k}" for k in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for p in r.sample(range(words), r.randrange(0, 14)):
            own[p] = f"x{seed}_{i}_{p}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile", [1500, 1 << 19])
def test_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE_NAMES", tile)
    texts = family(60, 1) + family(25, 2) + family(5, 3, 20)
    random.Random(1).shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in minhash.duplicate_report(df).collect()}
    want = brute.near_duplicates(docs)
    assert got == want and len({w[1] for w in want.values()}) > 6


def test_recall_on_a_table(spark):
    """Every link of sets at 0.8 or more, as the plain version finds them; all of them, not nine in ten."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: tuple(r)[1:] for r in minhash.duplicate_report(df).collect()}
    want = brute.near_duplicates([tuple(r) for r in df.collect()])
    assert got == want and sum(not w[2] for w in want.values()) > 20
