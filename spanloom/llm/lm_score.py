"""Cross-entropy difference between a target and a background language model.

Both models are interpolated n-gram models of order three over one vocabulary, the 256 byte values of
UTF-8, counted over every document: the background over all of them, the target over the chosen ones. A
document's score is the mean over its bytes of target loss less background loss, so lower is more like
the target. The tables have 256**3 entries at most, whatever the input, which bounds what each task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as T
from spanloom.llm.tables import sized
from spanloom.session import staged

#: Weight, in observations, of the shorter context in each order.
BACKOFF = 5.0
#: The byte, never part of UTF-8, that stands before a text.
START = 0xFF


def _codes(buf: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Every byte with the two before it in its row, as one number."""
    led = np.full(len(buf), START, dtype=np.int64)
    two = led.copy()
    led[1:], two[2:] = buf[:-1], buf[:-2]
    heads = cut[:-1][np.diff(cut) > 0]
    led[heads] = two[heads] = START
    after = heads[heads + 1 < len(buf)] + 1
    two[after] = START
    return two << 16 | led << 8 | buf


def _merge(one, two):
    codes, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    counts = np.zeros((len(codes), 2), dtype=np.int64)
    np.add.at(counts, at, np.concatenate([one[1], two[1]]))
    return codes, counts


def trigram_counts(documents: DataFrame) -> DataFrame:
    """``(code, background, target)`` over all rows of ``(text, target)``."""

    def run(batches):
        total = (np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64))
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            chosen = np.asarray(batch.column("target").fill_null(False))
            for a, z in T.chunks(offsets):
                cut = offsets[a : z + 1] - offsets[a]
                code = _codes(data[offsets[a] : offsets[z]], cut) << 1 | np.repeat(chosen[a:z], np.diff(cut))
                found, n = np.unique(code, return_counts=True)
                pair = np.zeros((len(found), 2), dtype=np.int64)
                pair[:, 0] = n
                pair[:, 1] = n * (found & 1)
                total = _merge(total, (found >> 1, pair))
        yield pa.RecordBatch.from_arrays(
            [pa.array(total[0].astype(np.int32)), pa.array(total[1][:, 0].copy()), pa.array(total[1][:, 1].copy())],
            ["code", "background", "target"],
        )

    parts = documents.select("text", "target").mapInArrow(run, "code int, background bigint, target bigint")
    return parts.groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Model:
    """Losses in nats of a byte after two others, from counts of trigrams."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes = codes
        one = np.bincount(codes & 0xFF, counts, 256)
        two = np.bincount(codes & 0xFFFF, counts, 1 << 16).reshape(256, 256)
        first = (one + BACKOFF / 256) / (one.sum() + BACKOFF)
        self.second = ((two + BACKOFF * first) / (two.sum(axis=1, keepdims=True) + BACKOFF)).reshape(-1)
        self.context = np.bincount(codes >> 8, counts, 1 << 16)
        self.known = -np.log((counts + BACKOFF * self.second[codes & 0xFFFF]) / (self.context[codes >> 8] + BACKOFF))

    def loss(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each code; ``place`` is its index among the counted codes, or -1."""
        unseen = -np.log(BACKOFF * self.second[code & 0xFFFF] / (self.context[code >> 8] + BACKOFF))
        return np.where(place >= 0, self.known[place], unseen) if len(self.known) else unseen


def score(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, target_loss, background_loss, score)`` of every row; losses are nats per byte.

    ``target_ids`` has the ids of the target documents in its first column; ids that no document has
    and nulls play no part. Null and empty texts have no tokens and null losses. Without target
    documents the target model is uniform. Rows are handled one by one: repeated rows count and are
    returned repeatedly, a null id stays null; other columns play no part.
    """
    target = staged(target_ids.select(F.col(target_ids.columns[0]).alias("id")).where("id is not null").distinct(), "target-ids")
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = rows.join(sized(target.withColumn("target", F.lit(True))), "id", "left")
    table = trigram_counts(marked).toPandas()  # 256**3 rows at most
    order = np.argsort(table["code"].to_numpy(), kind="stable")
    codes = table["code"].to_numpy()[order].astype(np.int64)
    columns = [table[c].to_numpy()[order] for c in ("target", "background")]
    shared = documents.sparkSession.sparkContext.broadcast((codes, *columns))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        codes, *columns = shared.value
        models = [Model(codes, c) for c in columns]
        index = np.full(1 << 24, -1, dtype=np.int32)
        index[codes] = np.arange(len(codes), dtype=np.int32)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            for a, z in T.chunks(offsets):
                cut = offsets[a : z + 1] - offsets[a]
                code = _codes(data[offsets[a] : offsets[z]], cut)
                place, n = index[code], np.diff(cut)
                some = n > 0
                losses = []
                for m in models:
                    mean = np.zeros(z - a)
                    if some.any():
                        mean[some] = np.add.reduceat(m.loss(code, place), cut[:-1][some]) / n[some]
                    losses.append(pa.array(mean, mask=~some))
                difference = np.asarray(losses[0].fill_null(0)) - np.asarray(losses[1].fill_null(0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, z - a), pa.array(n), *losses, pa.array(difference, mask=~some)],
                    ["id", "n_tokens", "target_loss", "background_loss", "score"],
                )

    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; the documents labelled as good are the target."""
    good = labels.where(F.col("quality") == 1).select("doc_id")
    return score(documents, good).withColumnRenamed("id", "doc_id")
