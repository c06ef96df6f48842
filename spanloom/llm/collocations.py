"""Phrase collocations from depth-truncated suffix subtrees, partitioned by the prefixes of the suffixes.

A first pass counts words. Frequent words, in order, are cut into groups of bounded total count, the
memory budget of a task; a word beyond the budget is extended to full depth, which deals its suffixes
over as many groups as it fills. A second pass sends every suffix, cut after ``depth`` words, to the
group of its prefix, equal ones of a chunk of text as one with its count. Each group sorts its suffixes,
which makes a subtree, independently of the others; totals of the leaves below a node are the count of
its phrase. Words below the least count end a suffix, as no phrase that is counted holds one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import text as T
from spanloom.llm.minhash import LOWER
from spanloom.operators.ranked import prefix_sums
from spanloom.session import staged

#: Words of the longest phrase, least count, phrases reported of each language, percent of the
#: occurrences of a phrase that lie in a longer one when it is dropped.
DEPTH, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Suffixes of a group: the memory budget of a task that builds subtrees.
BUDGET = 1_000_000
#: Bytes of text of a chunk; one longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20

IS_END = T.separators(b".,;:!?" + bytes(range(0x0A, 0x0E)))
IS_SEPARATOR = IS_END | T.separators(b" \t")


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compress better."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _chunks(documents: DataFrame) -> DataFrame:
    """``(chunk, lang, words, counts, places)``: the words of a chunk, and its text as their places.

    A place is 0 at the end of a piece and else 1 more than the word's index. Every language of a chunk has a row.
    """

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            codes = np.asarray(langs.indices)
            for a, z in T.chunks(offsets, CHUNK_BYTES):
                buf = LOWER[data[offsets[a] : offsets[z]]]
                starts, ends, rows = T.word_spans(buf, offsets[a : z + 1] - offsets[a], IS_SEPARATOR)
                if not len(starts):
                    continue
                names, first, place = np.unique(T.span_names(buf, starts, ends), return_index=True, return_inverse=True)
                text = np.repeat(np.arange(z - a), np.diff(rows))
                piece = np.cumsum(IS_END[buf], dtype=np.int64)[starts]
                last = np.ones(len(starts), dtype=bool)
                last[:-1] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
                lang, raw = codes[a:z][text], buf.tobytes()
                for code in np.unique(lang).tolist():
                    own = np.flatnonzero(lang == code)
                    seen, at = np.unique(place[own], return_inverse=True)
                    slots = np.arange(len(own)) + np.cumsum(last[own]) - last[own]
                    places = np.zeros(len(own) + int(last[own].sum()), dtype=np.uint32)
                    places[slots] = at + 1
                    words = [raw[p:q].decode() for p, q in zip(starts[first[seen]].tolist(), ends[first[seen]].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk]),
                            pa.array([langs.dictionary[code].as_py()], pa.string()),
                            pa.array([words], pa.list_(pa.string())),
                            pa.array([np.bincount(at, minlength=len(seen))], pa.list_(pa.int64())),
                            pa.array([_planes(places)], pa.binary()),
                        ],
                        ["chunk", "lang", "words", "counts", "places"],
                    )
                    chunk += 1

    return documents.mapInArrow(run, "chunk bigint, lang string, words array<string>, counts array<bigint>, places binary")


def vocabulary(words: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """``(lang, word, f, number, base, parts)`` of the frequent words: counts, numbers by (lang, word), groups.

    A word's suffixes go to group ``base``; those of a word above the budget to ``parts`` groups from there on.
    """
    frequent = words.where(F.col("f") >= least)
    numbered = prefix_sums(frequent, [], ["lang", "word"], {"number": F.lit(1).cast("bigint"), "upto": F.col("f")})
    return numbered.selectExpr(
        "lang", "word", "f", "number", f"(upto - f) div {budget} AS base", f"CAST(ceil(f / {budget}) AS bigint) AS parts"
    )


def _suffixes(chunks: DataFrame, depth: int) -> DataFrame:
    """``(group, hot, suffixes, counts)``: the different suffixes of each chunk, by the groups of their prefixes.

    ``suffixes`` holds ``depth`` planes of numbers one after the other; 0 stands behind the last word.
    """

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                known = batch.column("known")[r].values
                at, number, base, parts = (known.field(c).to_numpy() for c in ("at", "number", "base", "parts"))
                order = np.argsort(number)
                code = np.zeros(int(at.max()) + 2, dtype=np.int64)
                code[at[order] + 1] = np.arange(1, len(order) + 1)
                places = _numbers(batch.column("places")[r].as_py(), "<u4")
                line = np.append(np.where(places < len(code), code[np.minimum(places, len(code) - 1)], 0), np.zeros(depth, dtype=np.int64))
                heads = np.flatnonzero((line[:-1] > 0) & (line[1:] > 0))
                if not len(heads):
                    continue
                # Suffixes of two words, three and so on are named by their rank among all of the chunk.
                levels = [line[heads]]
                name, live = levels[0], np.ones(len(heads), dtype=bool)
                for k in range(1, depth):
                    live &= line[heads + k] > 0
                    levels.append(np.where(live, line[heads + k], 0))
                    _, index, name, count = np.unique(name * (len(order) + 1) + levels[k], return_index=True, return_inverse=True, return_counts=True)
                levels = [x[index] for x in levels]
                own = order[levels[0] - 1]
                hot = parts[own] > 1
                numbers = np.append(0, number[order]).astype(np.uint64)
                levels = [numbers[x] for x in levels]
                mixed = np.zeros(len(own), dtype=T.U64)
                for x in levels[1:]:
                    mixed = T.mix(mixed * T.U64(0x9E3779B97F4A7C15) + x)
                group = base[own] + ((mixed >> T.U64(1)).astype(np.int64) % parts[own])
                by = np.argsort(group * 2 + hot, kind="stable")
                keys = (group * 2 + hot)[by]
                cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                pieces = [by[p:q] for p, q in zip(cuts, np.append(cuts[1:], len(by)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[cuts] >> 1),
                        pa.array((keys[cuts] & 1).astype(bool)),
                        pa.array([b"".join(_planes(x[p]) for x in levels) for p in pieces], pa.binary()),
                        pa.array([_planes(count[p].astype(np.uint32)) for p in pieces], pa.binary()),
                    ],
                    ["group", "hot", "suffixes", "counts"],
                )

    return chunks.mapInArrow(run, "group bigint, hot boolean, suffixes binary, counts binary")


def subtree(suffixes: list[np.ndarray], counts: np.ndarray, least: int, whole: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phrases of two words and more with their counts, level by level, from suffixes in any order, equal ones repeated.

    Sorted suffixes are the leaves of the subtree from left to right, and a node's leaves stand
    together; the node's count is their total. Nodes below ``least`` are left out where their suffixes
    are ``whole``; phrases of full depth always are.
    """
    order = np.lexsort(suffixes[::-1])
    sorted_ = [x[order] for x in suffixes]
    totals = np.append(0, np.cumsum(counts[order]))
    fresh, out = np.zeros(len(order), dtype=bool), []
    fresh[:1] = True
    for k, level in enumerate(sorted_):
        fresh[1:] |= level[1:] != level[:-1]
        if not k:
            continue
        nodes = np.flatnonzero(fresh)
        total = np.diff(totals[np.append(nodes, len(order))])
        some = (level[nodes] > 0) & ((total >= least) | (not whole and k + 1 < len(sorted_)))
        out.append((np.stack([x[nodes[some]] for x in sorted_[: k + 1]], axis=1), total[some]))
    return out


def phrase_counts(documents: DataFrame, depth: int = DEPTH, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of words, of frequent words and of frequent phrases of ``documents`` (``lang``, ``text``), written.

    ``(lang, word, f)`` of all words; the :func:`vocabulary`; ``(phrase, a)`` with the numbers of the
    words of every phrase of 2 to ``depth`` words that occurs ``least`` times.
    """
    chunks = staged(_chunks(documents), "phrase-chunks")
    listed = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "word"))
    listed = listed.select("chunk", "lang", "at", "word.words", "word.counts").withColumnsRenamed({"words": "word", "counts": "f"})
    words = staged(listed.groupBy("lang", "word").agg(F.sum("f").alias("f")), "word-counts")
    known = staged(vocabulary(words, least, budget), "vocabulary")
    answers = listed.drop("f").join(known, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "number", "base", "parts")).alias("known"))
    suffixes = _suffixes(chunks.select("chunk", "places").join(answers, "chunk").select("places", "known"), depth)

    def run(table: pa.Table) -> pa.Table:
        out = []
        for hot in (False, True):
            own = table.filter(pa.compute.equal(table["hot"], hot))
            if not own.num_rows:
                continue
            raw = [x.as_py() for x in own["suffixes"]]
            levels = [
                np.concatenate([_numbers(x[k * len(x) // depth : (k + 1) * len(x) // depth], "<u8") for x in raw]).astype(np.int64)
                for k in range(depth)
            ]
            counts = np.concatenate([_numbers(x.as_py(), "<u4") for x in own["counts"]]).astype(np.int64)
            for phrases, total in subtree(levels, counts, least, whole=not hot):
                ends = np.arange(0, phrases.size + 1, phrases.shape[1], dtype=np.int32)
                out.append(pa.table([pa.ListArray.from_arrays(ends, phrases.reshape(-1)), pa.array(total)], ["phrase", "a"]))
        return pa.concat_tables(out)

    found = suffixes.groupBy("group").applyInArrow(run, "phrase array<bigint>, a bigint")
    # Only a phrase shorter than full depth that begins with a word above the budget comes from several groups.
    phrases = found.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words, known, staged(phrases, "phrases")


def collocations(
    documents: DataFrame,
    depth: int = DEPTH,
    least: int = LEAST,
    top: int = TOP,
    inside: int = INSIDE,
    budget: int = BUDGET,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. Phrases are 2 to ``depth`` words of one piece that occur ``least`` times in the
    language, overlaps included. Cutting one in two gives ``l`` and ``r``, the counts of its parts, and
    the score ``floor(1000000 a a / (l r))``; the cut of the lowest score counts, of equal ones the first.
    Phrases of which ``inside`` percent or more of the occurrences lie in one longer phrase are dropped.
    The order is score and ``a`` descending, then phrase. A null language is ``und``, a null text empty;
    every row counts, also repeated ones and those without id; other columns play no part.
    """
    rows = documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, known, phrases = phrase_counts(rows, depth, least, budget)
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "language-words")
    # A phrase of one word is a row like the longer ones, so that both parts of a cut are found in one table.
    parts = phrases.unionByName(known.select(F.array("number").alias("phrase"), F.col("f").alias("a")))
    cuts = phrases.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")).select(
        "phrase", "a", "k", F.slice("phrase", 1, "k").alias("left"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("right")
    )
    cuts = cuts.join(parts.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr(
        "(CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)) * CAST(1000000 AS decimal(7,0))) DIV (CAST(l AS decimal(15,0)) * CAST(r AS decimal(15,0)))"
    )
    least_cut = cuts.select("phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("phrase").agg(
        F.first("a").alias("a"), F.min("cut").alias("cut")
    )
    shorter = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("phrase") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("phrase") - n + 1), lambda i: F.slice("phrase", i, n)),
        )
    )
    longer = phrases.where(F.size("phrase") > 2).select(F.explode(shorter).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("phrase").agg(F.max("longer").alias("longer"))
    kept = least_cut.join(longer, "phrase", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside, F.lit(True)))
    kept = staged(kept.select("phrase", "a", "cut.l", "cut.r", "cut.score"), "kept-phrases")

    spelled = kept.select("phrase", F.posexplode("phrase").alias("at", "number")).join(known.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("phrase").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    ranked = kept.join(spelled, "phrase").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
