"""Every operator against its plain version, on a small table with awkward rows."""

import math
import random
import zlib

import llm_brute as brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanloom.llm import (
    bpe,
    decontamination,
    language_id,
    lm_score,
    minhash,
    neighbours,
    queries,
    substring_dedup,
    token_count,
    token_output,
    url_filter,
)

SF_DIR = "/root/testdata/sf0.001"
rng = random.Random(5)
WORDS = [f"{rng.choice('BcdfgLmnpst')}{rng.choice('aeiouéü')}{rng.choice('lmnrst')}{k}" for k in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE, PASSAGE = prose(300, 1), prose(70, 2)
ITEMS = [(7, prose(40, 3)), (12, "Only Five Words Here, Really"), (3, None), (4, ""), (5, "!!"), (7, prose(20, 4)), (None, prose(30, 9)), (70, prose(40, 3))]
TEXTS = [
    None,
    "",
    " \n\t ",
    "word",
    "Two words",
    "a b " * 3000,
    "a b " * 3000,
    BASE,
    BASE.replace(" ", "\n  ", 40),
    " ".join(BASE.split()[:280] + prose(20, 6).split()),
    prose(30, 11) + " " + PASSAGE + " " + prose(60, 12),
    prose(200, 13) + "\t" + PASSAGE,
    prose(20, 14) + " " + ITEMS[0][1].upper().replace("É", "é").replace("Ü", "ü") + " " + prose(10, 15),
    prose(500, 16) + " only five WORDS here--really " + prose(100, 17),
    "It's they're 's's ''s don'T we'll I'd x''t 'veto 're\u00a0'm \u3000\u3000nbsp \u2028line\r\n\r\n  end   ",
    "<|endoftext|> in the middle <|endoftext|>",
    "▁▁ blanks ▁x      many       " + " " * 50,
    "日本語のテキスト 한국어 🙂🙃 e\u0301 ½ ² Ⅷ \x00 \x1f \x7f",
    "x" * 3000,
    "=" * 700 + "-+" * 300,
    "long words " + "lorem" * 400,
    "short tail of fifty one words " * 9,
]
DOCS = list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def documents(spark):
    """Ids in no order, one row twice, a row without id, and columns named like inner ones."""
    rows = [*DOCS[::-1], DOCS[9]]
    df = spark.createDataFrame([(i, t, f"src{i % 2}") for i, t in rows], "doc_id bigint, text string, source string")
    extra = {c: F.lit(1) for c in ("id", "key", "n", "words", "h", "first", "runs", "bands", "component", "part", "a", "b", "lang_pred", "fps")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("window", F.lit(0))


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_substring_dedup(documents):
    assert by_id(substring_dedup.word_digests(documents)) == brute.substring_dedup(DOCS)


def test_substring_dedup_other_windows_and_stretches(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 128)
    assert by_id(substring_dedup.word_digests(documents, window=35)) == brute.substring_dedup(DOCS, 35)
    with pytest.raises(ValueError):
        substring_dedup.word_digests(documents, window=20).collect()


def test_remove_repeats_keeps_rows_and_columns(documents):
    out = substring_dedup.remove_repeats(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    want = brute.substring_dedup(DOCS)
    for i, text in out.select("doc_id", "text").collect():
        assert brute.sha(text) == want[i][2] if want[i][1] else text == dict(DOCS)[i]


def test_decontamination(documents, benchmark):
    got = by_id(decontamination.hit_report(documents, benchmark))
    want = brute.decontamination(DOCS, [x for x in ITEMS if x[0] is not None])
    assert got == want and sum(w[4] for w in want.values()) >= 1 and sum(w[1] > 0 for w in want.values()) >= 2
    kept = {r[0] for r in decontamination.drop_contaminated(documents, benchmark).select("doc_id").collect()}
    assert kept == {i for i in want if not want[i][4]}


def test_decontamination_without_items(documents, benchmark):
    got = by_id(decontamination.hit_report(documents, benchmark.limit(0)))
    assert got == brute.decontamination(DOCS, [])


def test_near_duplicates(documents):
    assert by_id(minhash.duplicate_report(documents)) == brute.near_duplicates(DOCS)


def test_near_duplicates_of_one_bucket(spark, monkeypatch):
    """A chain of links in which most pairs, and the pairs with the smallest id, are no links."""
    words = [f"w{k}" for k in range(200)]
    docs = [(i, " ".join(words[i * 4 : i * 4 + 80])) for i in range(30)]
    docs += [(100 + i, " ".join(words[i : i + 60] + [f"z{i}", f"y{i}"])) for i in range(5)]
    monkeypatch.setattr(minhash, "FIRST_CENTRES", 1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute.near_duplicates(docs)
    got = {r.id: r.component for r in minhash.near_duplicates(df, bands=60, width=1).collect()}
    assert got == {i: w[1] for i, w in want.items()} and len(set(got.values())) < 10


def test_keep_first(documents):
    want = {i for i, w in brute.near_duplicates(DOCS).items() if w[2]}
    out = minhash.keep_first(documents)
    assert out.columns == documents.columns and {r[0] for r in out.select("doc_id").collect()} == want


def test_byte_bpe(documents):
    got = by_id(bpe.token_digests(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert got == brute.byte_bpe(DOCS)


def test_byte_bpe_with_lists_started_anew(documents, monkeypatch):
    monkeypatch.setattr(bpe, "LIST_PIECES", 3)
    monkeypatch.setattr(bpe, "ROW_PIECES", 20)
    got = by_id(bpe.token_digests(documents.coalesce(1), public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert got == brute.byte_bpe(DOCS, "byte_bpe_50k.tiktoken")


def test_token_counts(documents):
    got = by_id(token_count.count_report(documents, public_tokenizers.path("piece_bpe_32k.model"), 500))
    assert got == brute.token_counts(DOCS, limit=500)


def test_token_output(documents):
    docs = documents.dropDuplicates(["doc_id"])
    assert by_id(token_output.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))) == brute.token_output(DOCS)


def test_token_files_hold_repeated_rows_in_order(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"), path, parts=3)
    rows = token_output.document_index(token_output.read_tokens(spark, path)).orderBy("start").collect()
    assert [r.id for r in rows] == sorted([*dict(DOCS), 9])
    assert all(x.start + x.n_tokens == y.start for x, y in zip(rows, rows[1:]))
    tokens = token_output.read_tokens(spark, path).where("id = 4").collect()[0].ids
    want = brute.token_output([DOCS[4]])[4]
    assert zlib.crc32(np.array(tokens, dtype="<u4").tobytes()) == want[2]


def test_empty_documents(spark, documents, benchmark):
    none = documents.limit(0)
    path = public_tokenizers.path
    assert substring_dedup.word_digests(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert decontamination.hit_report(none, benchmark).count() == 0
    assert minhash.duplicate_report(none).count() == 0
    assert bpe.token_digests(none, path("byte_bpe_multi_50k.tiktoken")).count() == 0
    assert token_count.count_report(none, path("piece_bpe_32k.model")).count() == 0
    assert token_output.round_trip(none, path("byte_bpe_50k.json")).count() == 0
    assert language_id.language_report(none.withColumn("lang", F.lit("en"))).count() == 0
    assert lm_score.quality_report(none, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert url_filter.verdict_report(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert neighbours.nearest_report(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (None, None), (1, PASSAGE + " x")], "doc_id bigint, text string")
    assert set(by_id(substring_dedup.word_digests(df))) == {1}
    assert by_id(minhash.duplicate_report(df)) == {1: (69, 1, True)}
    assert minhash.keep_first(df).count() == 4
    assert token_count.count_report(df, public_tokenizers.path("piece_bpe_32k.model")).where("doc_id is null").count() == 2
    rows = token_output.round_trip(df, public_tokenizers.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1]
    assert language_id.language_report(df.withColumn("lang", F.lit("en"))).count() == 4


def test_language_id(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_report(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    kept = language_id.drop_rejected(documents)
    assert kept.columns == documents.columns and kept.count() >= 0.98 * documents.count()


def test_language_id_of_awkward_texts(spark):
    labelled = [(i, f"the house and the garden of number {i} are here", "en") for i in range(30)]
    labelled += [(100 + i, f"das Haus und der Garten der Nummer {i} sind hier", "de") for i in range(30)]
    odd = [(200, None, None), (201, "", "en"), (202, "123 456 -- !", None), (203, "und der Garten und das Haus", None), (204, "ß", "de")]
    df = spark.createDataFrame([*labelled, *odd], "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    got = by_id(language_id.language_report(df))
    assert [got[i][1:] for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203][1] == "de" and got[204][1] in ("en", "de")
    none = language_id.language_report(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    same = by_id(language_id.language_report(df.drop("score").withColumn("source", F.lit(1)).repartition(5)))
    assert same == got


def plain_rule(host, path):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    urls = [
        None, "", "no scheme.com/x", "http://Example.COM/en/1", "http://www.example.com/en/1?x=/en/", "https://a.b.www.example.com/en/",
        "http://notexample.com/en/", "http://example.com", "http://example.com?x", "https://shop.net/es/#a", "https://net/fr/", "ftp://x.org/a://b/c",
        "http://xnet/fr/", "://com/", "http:///path", "http://example.com/EN/", "http://É.com/é?q#f",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("html", F.lit("the house"))
    for r in url_filter.verdict_report(df.withColumn("word", F.lit(1))).collect():
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end].translate(brute.LOWER), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_words_and_bayes(spark):
    assert url_filter.best_cut("goodhouse", {w: math.log(0.01) for w in ("good", "house", "go", "use")}, 100) == ["good", "house"]
    assert url_filter.best_cut("", {}, 1) == []
    pages = [(i, f"http://badcasino{i % 3}.net/es/casino/{i}", "good bad casino house garden") for i in range(30)]
    pages += [(100 + i, f"http://goodhouse{i % 3}.com/garden/{i}", "good house garden casino bad") for i in range(30)]
    pages += [(200, "http://casinobad.org/casino", None), (201, "http://housegood.org/garden", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_filter.verdict_report(df).collect()}
    assert (got[200].verdict, got[201].verdict) == ("block", "allow") and got[200].rule is None
    words = url_filter.host_words(df.selectExpr("'badcasino7.goodhouse.org' as host").distinct(), url_filter.word_counts(df, "html"))
    assert words.collect()[0].words[:4] == ["bad", "casino", "good", "house"]


def test_lm_score(spark):
    docs = [(i, f"clean plain prose number {i} for readers") for i in range(40)]
    docs += [(100 + i, f"zxq qqz {i} xkcd zzt vvk") for i in range(40)] + [(200, None), (201, ""), (202, "plain prose"), (203, "xkcd vvk zzt")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("target", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(101, 0), (999, 1), (None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in lm_score.quality_report(df, labels).collect()}
    assert len(got) == len(docs) and got[200].score is None and got[201].n_tokens == 0
    assert got[202].score < got[203].score and got[203].score > 0
    for i in (1, 202, 203):
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(plain_losses(docs, set(range(0, 40, 2)), dict(docs)[i]))


def plain_losses(docs, target, text):
    def grams(t):
        b = bytes([255, 255]) + t.encode()
        return [(b[k], b[k + 1], b[k + 2]) for k in range(len(b) - 2)]

    out = []
    for chosen in (target, None):
        seen = [g for i, t in docs if t and (chosen is None or i in chosen) for g in grams(t)]
        count = lambda f: {x: sum(f(g) == x for g in seen) for x in {f(g) for g in seen}}
        c1, c2, c3 = count(lambda g: g[2]), count(lambda g: g[1:]), count(lambda g: g)
        x1, x2, w = count(lambda g: g[1]), count(lambda g: g[:2]), lm_score.BACKOFF
        loss = 0.0
        for a, b, c in grams(text):
            p1 = (c1.get(c, 0) + w / 256) / (len(seen) + w)
            p2 = (c2.get((b, c), 0) + w * p1) / (x1.get(b, 0) + w)
            loss -= math.log((c3.get((a, b, c), 0) + w * p2) / (x2.get((a, b), 0) + w))
        out.append(loss / len(text.encode()))
    return tuple(out)


def plain_nearest(rows, queries, k=10):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            near = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)
            out[q] = near[:k]
    return out


def test_neighbours_of_awkward_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(1, 150)]
    rows += [(0, [1.0] * 6)] + [(200 + i, [1.0] * 6) for i in range(40)]
    rows += [(300, None), (400, []), (500, [0.0] * 6), (600, [float("nan")] * 6), (700, [1.0, None] * 3), (800, [float("inf")] * 6), (None, [1.0] * 6), (900, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit(0))
    got = {}
    for row in neighbours.nearest_report(df).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.score, row.vec_id))
    want = plain_nearest(rows[:-1], [0, 100, 200])
    assert got == want
    few = neighbours.nearest_report(df.where("vec_id in (0, 1, 2, 100)")).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in few} == {0: 3, 100: 3}


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = plain_nearest(rows, [i for i, _ in rows if i % 100 == 0])
    found = {}
    for r in queries.op10_neighbours(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & {i for _, i in near}) for q, near in want.items())
    assert found.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
