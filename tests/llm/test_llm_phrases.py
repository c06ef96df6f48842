"""Source mixing, periodic runs and collocations against their plain versions."""

import random
from collections import defaultdict

import llm_brute_phrases as brute
import numpy as np
import pytest
from llm_brute import space_words
from pyspark.sql import functions as F

from spanloom.llm import collocations, periodic_runs, queries, source_mix
from spanloom.llm import text as T

SF_DIR = "/root/testdata/sf0.001"
EXTRA = ("id", "key", "number", "start", "length", "period", "chunk", "words", "counts", "rank", "phrase", "n", "f", "a", "p", "copies", "rows", "row")
rng = random.Random(7)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


def noisy(n, kinds, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


PHRASES = "Hot Dog stand, hot dog stand; new york city: new york. hot dog\tstand\x0bnew york  city!"
TEXTS = [
    None, "", " \n\t", "word", "x " * 11, "x " * 12, "A b " * 3000, fibonacci(700), noisy(400, 2, 1), noisy(900, 3, 2), noisy(300, 500, 3),
    noisy(40, 90, 4) + " " + (noisy(60, 90, 5) + " ") * 7 + noisy(30, 90, 4), " ".join([noisy(37, 80, 6)] * 5), (PHRASES + "\n") * 12,
    "ünï čode ünï čode " * 9, "the the the the. " * 40, "." * 50 + "a.b" * 20, "\x01low \x01low, " * 30, "x" * 5000,
]
DOCS = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "é", "B"][i % 5]) for i, t in enumerate(TEXTS)]
DOCS += [(i, noisy(rng.randrange(1, 60), 6, i), "en", "b") for i in range(100, 160)]


@pytest.fixture(scope="module")
def documents(spark):
    """Repeated rows, rows without id, and columns named like inner ones."""
    rows = [*DOCS, DOCS[11], DOCS[7], (None, TEXTS[12], "en", "b"), (None, None, None, None), (3, "another text of id three", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in EXTRA}).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_transform_is_exact():
    r = np.random.default_rng(1)
    for n in (1, 2, 8, 64):
        a, b = (r.integers(0, periodic_runs.PRIME, (3, n)).astype(T.U64) for _ in range(2))
        assert (periodic_runs.ntt(periodic_runs.ntt(a), inverse=True) == a).all()
        got = periodic_runs.ntt(periodic_runs._mod(periodic_runs.ntt(a) * periodic_runs.ntt(b)), inverse=True)
        for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
            assert z == [sum(x[i] * y[(k - i) % n] for i in range(n)) % periodic_runs.PRIME for k in range(n)]


@pytest.mark.parametrize("least", [4, 7, 12, 30])
def test_runs_of_all_texts_at_once(least, monkeypatch):
    monkeypatch.setattr(periodic_runs, "REACH", 8)
    monkeypatch.setattr(periodic_runs, "EXTEND_AT_ONCE", 100)
    lists = [[], [1], [0] * 200, [0, 1] * 100, [bin(i).count("1") % 2 for i in range(300)], list(range(60)) * 3 + [7] + list(range(30)) * 2]
    for seed in range(60):
        r = random.Random(seed)
        w = [r.randrange(r.choice([2, 3, 40])) for _ in range(r.randrange(200))]
        a = r.randrange(len(w) + 1)
        p = 1 + r.randrange(len(w) // 2 + 1)
        lists.append([w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))])
    bounds = np.cumsum([0, *map(len, lists)])
    names = T.mix(np.array([x for w in lists for x in w], dtype=T.U64))
    got = periodic_runs.word_runs(names, bounds, least)
    for k, w in enumerate(lists):
        own = got[(got[:, 0] >= bounds[k]) & (got[:, 0] < bounds[k + 1])]
        assert [(s - bounds[k], q, n) for s, n, q in own.tolist()] == brute.runs(w, least)


def test_run_report(documents):
    got = rows_of(periodic_runs.run_report(documents.where("doc_id is not null")))
    rows = documents.where("doc_id is not null").select("doc_id", "text").collect()
    assert got == sorted(((i, *brute.run_report(i, t)) for i, t in rows), key=repr)


def test_run_report_of_planted_periods(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF_DIR).collect()}
    assert got == {r.doc_id: brute.run_report(r.doc_id, r.text) for r in df.collect()}
    assert sum(r[0] > 0 for r in got.values()) >= 0.05 * len(got)


def test_runs_and_collapsed_texts(documents):
    want = sorted(
        ((i, s, n, q) for i, t in documents.select("doc_id", "text").collect() for s, q, n in brute.runs(space_words(t))), key=repr
    )
    assert rows_of(periodic_runs.periodic_runs(documents)) == want
    out = periodic_runs.collapse_runs(documents)
    assert out.columns == documents.columns and out.schema["text"] == documents.schema["text"]
    collapsed = []
    for i, t in documents.select("doc_id", "text").collect():
        found = brute.runs(space_words(t))
        collapsed.append((i, " ".join(brute.kept_words(space_words(t), found)) if found else t))
    assert rows_of(out.select("doc_id", "text")) == sorted(collapsed, key=repr)


@pytest.mark.parametrize("budget", [1_000_000, 7, 1])
def test_collocations(documents, budget):
    want = brute.collocations([tuple(r) for r in documents.select("lang", "text").collect()])
    assert len(want) > 20 and len({r[0] for r in want}) == 3
    assert rows_of(collocations.collocations(documents, budget=budget)) == sorted(want, key=repr)


def test_collocations_of_other_depths_and_limits(documents, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 500)
    rows = [tuple(r) for r in documents.select("lang", "text").collect()]
    for depth, least, top, inside in ((2, 3, 5, 50), (5, 4, 60, 80)):
        want = brute.collocations(rows, depth, least, top, inside)
        assert rows_of(collocations.collocations(documents, depth, least, top, inside, budget=50)) == sorted(want, key=repr)


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source_size, r.target].append(r)
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_mix(documents, monkeypatch, bucket):
    monkeypatch.setattr(source_mix, "BUCKET", bucket)
    rows = source_mix.mix_report(documents).collect()
    texts = documents.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for _, s, t in texts:
        sizes[s] += len(space_words(t))
    want = brute.targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, len(space_words(t))) for i, _, t in texts)
    for r in rows:
        assert any(r.source_size == sizes[s] and r.target == pytest.approx(float(t)) for s, t in want.items())
    for (size, target), own in by_source(rows).items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        for r in own:
            low = int(target / size + 1e-9) if size else 0
            assert r.size == 0 or r.taken // r.size in (low, low + 1) and r.taken % r.size == 0 and r.taken <= 2 * r.size
    again = source_mix.mix_report(documents.repartition(5, "text")).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_targets_of_many_shapes(spark):
    for seed in range(3):
        r = random.Random(seed)
        sizes = {s: r.choice([0, 1, 7, 100, 10**12]) for s in [None, "", "A", "a", "é", "z", "\U0001f642", "￿", "b", "c"][: 3 + seed * 3]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {x.source: x.target for x in source_mix.source_targets(df).collect()}
        assert got == {s: pytest.approx(float(t)) for s, t in brute.targets(sizes).items()}


def test_fractions_keep_their_sum_and_expectation():
    r = np.random.default_rng(2)
    p, size = r.random(41), r.integers(1, 500, 41)
    sums = np.zeros(41)
    for seed in range(4000):
        out = source_mix.meet(p, size, T.mix(np.arange(41, dtype=T.U64) + T.U64(seed << 20)))
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and (out @ size) == pytest.approx(p @ size)
        sums += out
    assert np.abs(sums / 4000 - p).max() < 0.04


def test_mixed_rows(documents):
    taken = source_mix.copies(documents).agg(F.sum("copies")).first()[0]
    out = source_mix.mix(documents)
    assert out.columns == documents.columns and out.count() == taken
    before = {(r.doc_id, r.text): r.n for r in documents.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect():
        assert r.n <= 2 * before[r.doc_id, r.text]


def test_no_documents(documents):
    none = documents.limit(0)
    assert source_mix.mix_report(none).count() == 0 and source_mix.mix(none).count() == 0
    assert periodic_runs.run_report(none).count() == 0 and periodic_runs.collapse_runs(none).count() == 0
    assert collocations.collocations(none).count() == 0
    blank = documents.withColumn("text", F.lit(None).cast("string"))
    assert collocations.collocations(blank).count() == 0
    assert {(r.size, r.target, r.taken) for r in source_mix.mix_report(blank).collect()} == {(0, 0.0, 0)}
