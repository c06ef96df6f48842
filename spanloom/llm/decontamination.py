"""Benchmark passages in documents, by winnowed fingerprints. DataFrame functions only.

Of every ``WINDOW - GRAM + 1`` consecutive word k-grams the one with the smallest hash is kept, on
both sides alike, so two texts that share ``WINDOW`` words share a fingerprint. Documents that share
one are candidates; their windows are then compared with those of the benchmark, by hash and word for
word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import keep_keys, row_key, sized, unique_rows
from spanloom.session import staged

WINDOW, GRAM = 13, 7
#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower_ascii(word: Column) -> Column:
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def raw_words(text: Column) -> Column:
    """The words of a text before A-Z are lower-cased; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def _neighbours(df: DataFrame, source: str, n: int, out: str, join) -> DataFrame:
    """``out[i]`` joins ``source[i .. i + n - 1]``, by doubling; as long as ``source`` less ``n - 1``.

    Each step is a projection of its own, so no array is computed twice.
    """
    kept = df.columns
    df = df.withColumn("__have", F.col(source))
    size = 1
    while size < n:
        by = min(size, n - size)
        df = df.withColumn("__have", F.zip_with("__have", F.slice("__have", by + 1, F.greatest(F.size("__have"), F.lit(1))), join))
        size += by
    length = F.greatest(F.size(source) - (n - 1), F.lit(0))
    return df.select(*kept, F.slice("__have", 1, length).alias(out))


def _grams(df: DataFrame, n: int, out: str) -> DataFrame:
    return _neighbours(df, "h", n, out, lambda a, b: F.xxhash64(a, b))


def _hashed(df: DataFrame, text_col: str) -> DataFrame:
    """Replaces the text by its words and the words' hashes ``h``."""
    df = df.withColumn("words", raw_words(F.col(text_col))).drop(text_col)
    return df.withColumn("h", F.transform("words", lambda w: F.xxhash64(_lower_ascii(w))))


def fingerprints(df: DataFrame, short: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds ``fps``: the least k-gram hash of each run of k-grams, and whole hashes of ``short`` lengths.

    Windows of ``short`` words (benchmark items below ``window`` words) have no run of k-grams of
    their own and are looked up whole.
    """
    kept = df.columns
    df = _grams(df, gram, "g")
    df = _neighbours(df, "g", window - gram + 1, "least", lambda a, b: F.least(a, b))
    parts = [F.array_distinct("least")]
    for n in short:
        df = _grams(df, n, f"short{n}")
        parts.append(F.array_distinct(f"short{n}"))
    return df.select(*kept, (F.array_distinct(F.concat(*parts)) if short else parts[0]).alias("fps"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, n, window, words)`` of each distinct window of each item: its length, text and words."""
    items = _hashed(
        benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "text"
    ).where(F.size("words") > 0)
    items = items.withColumn("words", F.transform("words", _lower_ascii))
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1))
    windows = items.select("item", "n", "words", at.alias("at")).select(
        "item", "n", F.slice("words", F.col("at"), F.col("n")).alias("words")
    )
    return windows.select("item", "n", F.concat_ws(" ", "words").alias("window"), "words").distinct()


def find_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, n_words, n_hit, items)`` of every document.

    Words are runs of digits, A-Z, a-z and non-ASCII characters, with A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or a whole shorter item. ``n_hit`` counts the document
    words inside any occurrence of a window, ``items`` lists the ids (as sorted strings) of items with
    an occurring window. Null and empty texts have no words; items without words or id have no
    windows; with an empty benchmark nothing is hit. Of documents that share an id one is used (see
    :func:`tables.unique_rows`), those without id are left out; items that share an id count once.
    Other columns play no part.
    """
    docs = unique_rows(documents, id_col, text_col).toDF("id", "text")
    windows = staged(item_windows(benchmark, window, item_col, item_text_col), "item-windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``window`` numbers
    short = [n for n in lengths if n < window]

    by_hash, keys = [], []
    for n in lengths:
        own = windows.where(F.col("n") == n).select("window", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
        hashes = _grams(own, n, "g").select("window", F.lit(n).alias("n"), F.col("g")[0].alias("h"))
        by_hash.append(hashes)
        if n == window:
            keys.append(fingerprints(own, [], window, gram).select(F.explode("fps").alias("fp")))
        else:
            keys.append(hashes.select(F.col("h").alias("fp")))
    hashed = _hashed(docs, "text")
    if not lengths:
        return hashed.select(
            "id", F.size("words").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items")
        )
    keys = staged(_union(keys).distinct(), "item-fingerprints")
    by_hash = staged(_union(by_hash).distinct(), "window-hashes")

    # A document's fingerprints stand together in one task, so the sums below shrink before they move.
    marked = keys.withColumn("seen", F.lit(1))
    found = (
        fingerprints(hashed, short, window, gram)
        .select("id", F.size("words").cast("bigint").alias("n_words"), F.explode_outer("fps").alias("fp"))
        .join(sized(marked), "fp", "left")
        .groupBy("id")
        .agg(F.max("n_words").alias("n_words"), F.max("seen").alias("seen"))
    )
    found = staged(found, "documents-with-fingerprints")

    candidates = _hashed(keep_keys(docs, found.where("seen = 1").select("id"), ["id"]), "text")
    candidates = candidates.withColumn("words", F.transform("words", _lower_ascii))
    candidates = staged(candidates, "candidate-words")
    places = _union(
        [
            _grams(candidates, n, "g").select("id", F.lit(n).alias("n"), F.posexplode("g").alias("at", "h"))
            for n in lengths
        ]
    )
    places = keep_keys(places, staged(by_hash.select("n", "h").distinct(), "window-keys"), ["n", "h"])
    hits = places.join(by_hash, ["n", "h"]).groupBy("id").agg(F.collect_list(F.struct("at", "n", "window")).alias("hits"))
    # Equal hashes are extended to equal words.
    checked = candidates.select("id", "words").join(hits, "id").select(
        "id",
        F.array_sort(
            F.filter("hits", lambda x: F.concat_ws(" ", F.slice(F.col("words"), x["at"] + 1, x["n"])) == x["window"])
        ).alias("hits"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).alias("reach"))

    def cover(state, x):
        end = x["at"] + x["n"]
        fresh = F.greatest(end - F.greatest(x["at"], state["reach"]), F.lit(0))
        return F.struct((state["hit"] + fresh).alias("hit"), F.greatest(state["reach"], end).alias("reach"))

    checked = staged(
        checked.select(
            "id",
            F.aggregate("hits", start, cover, lambda s: s["hit"]).alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda x: x["window"])).alias("windows"),
        ),
        "checked-hits",
    )
    items = (
        checked.select("id", F.explode("windows").alias("window"))
        .join(windows.select("window", "item").distinct(), "window")
        .groupBy("id")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return (
        found.select("id", "n_words")
        .join(checked.select("id", "n_hit"), "id", "left")
        .join(items, "id", "left")
        .select(
            "id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A document is contaminated if at least a twentieth of its words, and one at least, is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def hit_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts, a digest of the items and the verdict, one row per document."""
    return find_hits(documents, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without the contaminated ones; clean documents keep all their rows and columns.

    Every row is judged by its own text, also rows that share an id; rows without id stay.
    """
    keyed = documents.withColumn("__row", row_key(documents, id_col, text_col))
    bad = find_hits(keyed, benchmark, id_col="__row", text_col=text_col)
    bad = staged(bad.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias("__row")), "contaminated")
    return keyed.join(sized(bad), "__row", "left_anti").select(*documents.columns)
