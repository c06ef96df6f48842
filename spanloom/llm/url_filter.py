"""Rules for hosts and paths, and a classifier on the words that hosts are made of.

Host names are runs of words without blanks. A unigram model, counted over all page texts, gives the
most probable cut (Viterbi). Multinomial naive Bayes, counted over all pages that a rule judges, scores
the words of host and path; pages that no rule judges get its verdict.
"""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import staged

#: Fixed values of the task: verdict, host and start of the path, written as host + path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Letters of the longest word that a host is cut into.
LONGEST = 20
#: Rows up to which the words' weights are sent to every task.
BROADCAST_WORDS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and urls without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; of rules of one length the last counts."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes last, outermost
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """``(word, n)``: how often each run of a-z, lower-cased, stands in all texts; tags are left out."""
    plain = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, "[^a-z]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_cut(text: str, log_share: dict[str, float], total: float) -> list[str]:
    """The most probable cut of ``text`` into words; unknown words cost more with every letter."""
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            known = log_share.get(text[start:end])
            cost = known if known is not None else -math.log(total) - (end - start) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(max(options))
    words, end = [], len(text)
    while end:
        start = best[end][1]
        words.append(text[start:end])
        end = start
    return words[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, words)``: the words of every run of letters in each host, from the left.

    Only the counts of strings that stand in a host are moved to it.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    runs = F.filter(F.split("host", "[^a-z]+"), lambda r: r != "")
    pieces = F.transform(
        runs,
        lambda r: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(r)),
                lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(r) - i + 1)), lambda n: F.substring(r, i, n)),
            )
        ),
    )
    wanted = hosts.select("host", F.explode(F.array_distinct(F.flatten(pieces))).alias("word"))
    known = wanted.join(counts, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                share = {k["word"]: math.log(k["n"] / total) for k in row["known"] or ()}
                out.append([w for r in row["runs"] for w in best_cut(r, share, total)])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.string()))], ["host", "words"])

    joined = hosts.join(known, "host", "left").select("host", runs.alias("runs"), "known")
    return joined.mapInArrow(run, "host string, words array<string>")


def path_words(path: Column) -> Column:
    """Lower-cased words of a path; a run of digits is one word, ``#``."""
    low = F.translate(path, string.ascii_uppercase, string.ascii_lowercase)
    parts = F.split(F.regexp_replace(low, "[0-9]+", "#"), r"[\x00-\x22\x24-\x60\x7B-\x7F]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.concat(F.lit("/"), w))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` of every row.

    The longest rule decides that fits the host or one of its parent domains and the start of the
    path. Elsewhere naive Bayes does: ``score`` is the log ratio of block to allow, given for all
    pages; above 0 a page is blocked. Without pages of both verdicts to learn from, the score is 0
    and the page is allowed. Rows are judged one by one: repeated rows give repeated results, null
    ids, urls and texts are no obstacle, other columns play no part.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = staged(rows.withColumn("rule", rule).withColumn("ruled", verdict), "judged-by-rule")

    counts = staged(word_counts(pages, text_col), "word-counts")
    hosts = rows.select("host").distinct()
    cut = staged(host_words(hosts, counts), "host-words")

    # Pages with one host and path are alike, and hot ones are counted before they meet their words.
    kinds = rows.groupBy("host", "path").agg(F.count("*").alias("pages"), F.first("ruled").alias("ruled"))
    kinds = staged(kinds.join(cut, "host"), "kinds-of-pages")
    words = kinds.select("host", "path", "pages", "ruled", F.explode(F.concat("words", path_words(F.col("path")))).alias("word"))
    block = lambda n: F.sum(F.when(F.col("ruled") == "block", n).otherwise(0))
    allow = lambda n: F.sum(F.when(F.col("ruled") == "allow", n).otherwise(0))
    learned = words.groupBy("word").agg(block(F.col("pages")).alias("b"), allow(F.col("pages")).alias("a")).where("a + b > 0")
    learned = staged(learned, "learned-words")
    totals = learned.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    priors = kinds.agg(block(F.col("pages")), allow(F.col("pages"))).first()
    if priors[0] and priors[1]:
        size = totals[2]
        weight = F.log((F.col("b") + 1) / F.lit(float(totals[0] + size))) - F.log((F.col("a") + 1) / F.lit(float(totals[1] + size)))
        weights = learned.select("word", weight.alias("weight"))
        if size <= BROADCAST_WORDS:
            weights = F.broadcast(weights)
        prior = math.log(priors[0] / priors[1])
        scores = words.join(weights, "word").groupBy("host", "path").agg(F.round(F.sum("weight") + F.lit(prior), 9).alias("score"))
        scores = kinds.select("host", "path").join(scores, ["host", "path"], "left").fillna(round(prior, 9), ["score"])
    else:
        scores = kinds.select("host", "path", F.lit(0.0).alias("score"))
    scored = rows.join(staged(scores, "scores"), ["host", "path"])
    by_words = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("id", "host", "path", "rule", F.coalesce("ruled", by_words).alias("verdict"), "score")


def verdict_report(pages: DataFrame) -> DataFrame:
    return judge(pages).withColumnRenamed("id", "page_id")
