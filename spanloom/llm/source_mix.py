"""Mixing sources to target weights by pivotal dependent rounding.

A source's words are to be taken ``target / size`` times, so each of its documents has a whole number
of copies and a fraction of a further one. Two fractions meet: words move from one document to the
other, up to the point where one of them is whole; a coin that keeps both expectations says which way.
Nothing is lost on the way, so the words taken of a source differ from its target by at most one
document. Documents are ranked by a hash within their source and dealt into buckets of fixed size; a
bucket leaves one fraction at most, and these meet again in buckets of buckets, up to one per source.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.joins import join_null_safe
from spanloom.llm import text as T
from spanloom.operators.ranked import prefix_sums, ranked
from spanloom.session import staged

#: Weights of the sources in order, all targets in percent of all words, most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 150, 2
#: Fractions that meet in one task.
BUCKET = 4096
#: Fractions as close as this to a whole number are whole.
NEAR = 1e-12
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, number, target)`` of ``sources`` (``source``, ``source_size``), one row each.

    Sources are numbered from 1 by code point, null last; ``weights`` repeat along the numbers. Targets
    are in proportion to the weights, sum up to ``share`` percent of all sizes and stop at ``most``
    times a source's size; the excess goes to the others by weight. Sorted by size against weight, the
    sources that stop are the first ones, so running sums over that order say which they are.
    """
    place = F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), place)
    numbered = ranked(sources.select("source", "source_size"), [], [F.col("source").asc_nulls_last()])
    numbered = numbered.withColumnRenamed("row_number", "number").drop("group_rows").withColumns(
        {"weight": weight, "cap": F.col("source_size") * most}
    )
    order = [F.col("cap") * F.call_function("div", F.lit(lcm(*weights)).cast("bigint"), "weight"), F.col("number")]
    ordered = numbered.withColumns({"_by": order[0]})
    sums = prefix_sums(ordered, [], ["_by", "number"], {"caps": F.col("cap"), "weights": F.col("weight"), "sizes": F.col("source_size")})

    def wide(c):
        return c.cast("decimal(19,0)")

    left = F.col("sizes_total") * share - (F.col("caps") - F.col("cap")) * 100
    rest = (F.col("weights_total") - F.col("weights") + F.col("weight")) * 100
    sums = staged(sums.withColumn("stops", wide(left) * wide(F.col("weight")) >= wide(rest) * wide(F.col("cap"))), "source-sums")
    level = sums.agg(
        ((F.max("sizes_total") * share - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)) * 100) / 100).alias("words"),
        F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).alias("weights"),
    ).select((F.col("words") / F.nullif(F.col("weights"), F.lit(0))).alias("level"))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * level.scalar())
    return sums.select("source", "source_size", "number", target.alias("target"))


def _coin(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from the two keys."""
    x = T.mix(T.mix(a + T.U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) ^ (b * T.U64(0xD6E8FEB86659FD93)))
    return (x >> T.U64(11)).astype(np.float64) / (1 << 53)


def meet(p: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int = 0) -> np.ndarray:
    """The fractions ``p`` after all have met in pairs, round by round: all are 0 or 1, but one at most.

    A step keeps the sum of ``p * size`` and the expectation of every fraction.
    """
    p, size = p.astype(np.float64), size.astype(np.float64)
    live = np.flatnonzero((p > 0) & (p < 1))
    turn = 0
    while len(live) > 1:
        half = len(live) // 2
        i, j = live[: 2 * half : 2], live[1 : 2 * half : 2]
        has_i, has_j, full_i, full_j = p[i] * size[i], p[j] * size[j], size[i], size[j]
        to_i, to_j = np.minimum(full_i - has_i, has_j), np.minimum(has_i, full_j - has_j)
        turn += 1
        gains = _coin(key[i], key[j], seed * 64 + turn) * (to_i + to_j) < to_j
        moved = np.where(gains, to_i, -to_j)
        p_i, p_j = (has_i + moved) / full_i, (has_j - moved) / full_j
        p_i[gains & (to_i == full_i - has_i)] = 1
        p_j[gains & (to_i == has_j)] = 0
        p_i[~gains & (to_j == has_i)] = 0
        p_j[~gains & (to_j == full_j - has_j)] = 1
        p[i], p[j] = p_i, p_j
        p[p < NEAR] = 0
        p[p > 1 - NEAR] = 1
        live = live[(p[live] > 0) & (p[live] < 1)]
    return p


def _rounded(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """``rows`` with the fractions left after each bucket's have met; the last level tosses for what is left."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("size", "ascending")])
        key = table["key"].to_numpy().view(T.U64)
        p = meet(table["p"].to_numpy(), table["size"].to_numpy(), key, level)
        if last:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            p[open_] = _coin(key[open_], key[open_], level * 64) < p[open_]
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return rows.groupBy("number", "bucket").applyInArrow(run, rows.schema)


def copies(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: int = SHARE,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(id, key, size, source_size, target, copies)``: how often the mix takes each row of ``documents``.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+``; null, empty and blank texts have none and play
    no part in the sums. A null source is a source like any other. Every row is rounded on its own,
    also rows that share an id or are equal; a null id stays null. ``copies`` is one of the two whole
    numbers around ``target / source_size``. ``key`` hashes id, source and text; ranks and coins follow
    from it, so the result depends neither on partitions nor on the run. Other columns play no part.
    """
    rows = documents.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _key(id_col, source_col, text_col).alias("key"),
    )
    rows = staged(rows, "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = staged(targets, "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = join_null_safe(rows, targets.select("source", "number", rate.alias("rate")), ["source"]).select(
        "id", "key", "size", "number", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p")
    )
    split = (F.col("p") > NEAR) & (F.col("p") < 1 - NEAR) & (F.col("size") > 0)
    done = [rated.where(~split).withColumn("p", F.round("p"))]
    # Rows that agree in all of this can stand for one another, so any order among them will do.
    open_ = ranked(rated.where(split).withColumn("_tie", F.monotonically_increasing_id()), ["number"], ["key", "size", "_tie"])
    most_rows = staged(open_.select("number", "row_number").groupBy("number").agg(F.max("row_number").alias("rows")), "mix-ranks")
    most_rows = most_rows.agg(F.max("rows")).first()[0] or 0
    open_ = open_.withColumn("bucket", F.call_function("div", F.col("row_number") - 1, F.lit(BUCKET).cast("bigint")))
    open_ = open_.select("id", "key", "size", "number", "whole", "p", "bucket")
    level, left = 0, most_rows
    while True:
        last = left <= BUCKET
        met = staged(_rounded(open_, level, last), "mix-rounded")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(met.where(~still).drop("bucket"))
        if last:
            break
        open_ = met.where(still).withColumn("bucket", F.call_function("div", "bucket", F.lit(BUCKET).cast("bigint")))
        left, level = -(-left // BUCKET), level + 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.join(targets.drop("source"), "number").select(
        "id", "key", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("bigint")).alias("copies")
    )


def _key(*columns: str) -> Column:
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.xxhash64(*marks, *[F.col(c).isNull() for c in columns])


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``documents``, each as often as :func:`copies` says.

    Rows that agree in id, source and text share their copies evenly, whatever their other columns
    hold; which of them get one more is open.
    """
    taken = copies(documents, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    by_key = taken.groupBy("key", "id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    packed = documents.select(
        F.struct(*documents.columns).alias("row"), F.col(id_col).alias("id"), _key(id_col, source_col, text_col).alias("key")
    )
    dealt = staged(join_null_safe(packed, staged(by_key, "mix-copies"), ["key", "id"]), "mix-dealt")
    alone = dealt.where("rows = 1").select("row", "copies")
    equal = ranked(dealt.where("rows > 1").withColumn("_tie", F.monotonically_increasing_id()), ["key", "id"], ["_tie"])
    equal = equal.selectExpr("row", "copies div rows + int(row_number <= copies % rows) AS copies")
    every = alone.unionByName(equal).where("copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_report(documents: DataFrame) -> DataFrame:
    """Size, target and words taken of every document."""
    return copies(documents).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
