"""Cross-entropy difference between a target and a background model of words.

Both models are interpolated bigram models over one vocabulary, all words of all documents: the
background counted over all of them, the target over the chosen ones. A document's score is the mean
over its words of target loss less background loss, so lower is more like the target.

The tables of word and bigram counts grow with the corpus, so nobody holds them whole. Documents are
packed into chunks of bounded size. A chunk sends each of its distinct words and bigrams once, with its
own counts, to the bucket that its hash names. A bucket sums the counts of all chunks and answers each
of them; a chunk's documents are scored with the answers of all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as T
from spanloom.llm.minhash import LOWER
from spanloom.llm.tables import sized
from spanloom.session import staged

#: Weight, in observations, of the shorter context in each order.
BACKOFF = 5.0
#: Bytes of text of a chunk; one longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Buckets at least, and words of the corpus for each further one.
LEAST_BUCKETS, BUCKET_WORDS = 256, 4_000_000
#: The name that stands for the start of a text.
START = T.U64(0x5851F42D4C957F2D)


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, which compress better."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed(documents: DataFrame) -> DataFrame:
    """Chunks of ``(id, text, target)``: ids, word counts and marks of the rows, word names, word places."""
    kind = documents.schema["id"].dataType.simpleString()

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            chosen = batch.column("target").fill_null(False)
            most = -(-int(offsets[-1]) // max(-(-int(offsets[-1]) // CHUNK_BYTES), 1))
            for a, z in T.chunks(offsets, most):
                buf = LOWER[data[offsets[a] : offsets[z]]]
                starts, ends, rows = T.word_spans(buf, offsets[a : z + 1] - offsets[a], T.IS_SPACE)
                names, place, seen = np.unique(T.span_names(buf, starts, ends), return_inverse=True, return_counts=True)
                order = np.argsort(-seen, kind="stable")  # frequent words get small numbers
                rank = np.empty(len(order), dtype=np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                n, one = np.diff(rows), np.array([0, z - a], dtype=np.int32)
                in_target = int(n[np.asarray(chosen.slice(a, z - a))].sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk]),
                        pa.array([len(place)]),
                        pa.array([in_target]),
                        pa.ListArray.from_arrays(one, batch.column("id").slice(a, z - a)),
                        pa.ListArray.from_arrays(one, pa.array(n.astype(np.int64))),
                        pa.ListArray.from_arrays(one, chosen.slice(a, z - a)),
                        pa.array([_planes(names[order])], pa.binary()),
                        pa.array([_planes(rank[place])], pa.binary()),
                    ],
                    ["chunk", "n", "n_target", "ids", "lengths", "chosen", "names", "places"],
                )
                chunk += 1

    schema = f"chunk bigint, n bigint, n_target bigint, ids array<{kind}>, lengths array<bigint>, chosen array<boolean>, names binary, places binary"
    return documents.select("id", "text", "target").mapInArrow(run, schema)


class Grams:
    """The words and bigrams of a chunk. ``keys`` are sorted, those of words are odd, those of bigrams even.

    ``word`` and ``pair`` have the index among ``keys`` of each token and of the bigram that ends there,
    ``before`` that of the word in front, ``start`` that of the mark in front of each text.
    """

    def __init__(self, names: bytes, places: bytes, lengths: np.ndarray):
        names, place = _numbers(names, "<u8"), _numbers(places, "<u4").astype(np.int64)
        self.lengths = lengths
        self.heads = (np.cumsum(lengths) - lengths)[lengths > 0]
        names = np.append(names, START)
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[self.heads] = len(names) - 1
        ahead = T.mix(names) * T.U64(0x9E3779B97F4A7C15)
        pairs, pair = np.unique(T.mix(ahead[before] ^ names[place]) & ~T.U64(1), return_inverse=True)
        keys = np.concatenate([T.mix(names) | T.U64(1), pairs]) if len(place) else pairs
        order = np.argsort(keys, kind="stable")
        at = np.empty(len(keys), dtype=np.int64)
        at[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.word, self.before = (at[place], at[before]) if len(place) else (place, before)
        self.pair = at[len(names) + pair] if len(place) else place
        self.start = at[len(names) - 1] if len(place) else -1

    def counts(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """How often each of ``keys`` occurs, in all texts or in the chosen ones; the start occurs once a text."""
        some = slice(None) if chosen is None else np.repeat(chosen, self.lengths)
        out = np.bincount(self.word[some], minlength=len(self.keys)) + np.bincount(self.pair[some], minlength=len(self.keys))
        if self.start >= 0:
            out[self.start] += np.count_nonzero((self.lengths > 0) & (True if chosen is None else chosen))
        return out


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, chunk, keys, counts)``: what each chunk has of each bucket."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("chunk", "lengths", "chosen", "names", "places")}
                grams = Grams(row["names"].as_py(), row["places"].as_py(), np.asarray(row["lengths"].values))
                counts = [grams.counts().astype(np.uint32), grams.counts(np.asarray(row["chosen"].values)).astype(np.uint32)]
                edges = np.searchsorted((grams.keys >> T.U64(32)) * T.U64(buckets) >> T.U64(32), np.arange(buckets + 1, dtype=T.U64))
                full = np.flatnonzero(np.diff(edges))
                cuts = [slice(edges[k], edges[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full.astype(np.int64)),
                        pa.array(np.full(len(full), row["chunk"].as_py(), dtype=np.int64)),
                        pa.array([_planes(grams.keys[c]) for c in cuts], pa.binary()),
                        *[pa.array([_planes(x[c]) for c in cuts], pa.binary()) for x in counts],
                    ],
                    ["bucket", "chunk", "keys", "background", "target"],
                )

    return chunks.select("chunk", "lengths", "chosen", "names", "places").mapInArrow(
        run, "bucket bigint, chunk bigint, keys binary, background binary, target binary"
    )


def _answered(asked: DataFrame) -> DataFrame:
    """``(chunk, bucket, words, background, target)``: counts over all chunks in the order of the keys asked for.

    ``words`` has, in one row of each bucket, the number of its different words.
    """

    def run(table):
        parts = [_numbers(x.as_py(), "<u8") for x in table["keys"]]
        ends = np.cumsum([0, *map(len, parts)])
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums = []
        for c in ("background", "target"):
            own = np.concatenate([_numbers(x.as_py(), "<u4") for x in table[c]])
            total = np.bincount(at, own, len(keys)).astype(np.int64)  # exact below 2**53
            sums.append(pa.array([_planes(total[at[p:q]]) for p, q in zip(ends, ends[1:])], pa.binary()))
        words = np.zeros(len(parts), dtype=np.int64)
        words[0] = np.count_nonzero((keys & T.U64(1)) > 0) - np.count_nonzero(keys == T.mix(np.array([START])) | T.U64(1))
        return pa.table([table["chunk"], table["bucket"], pa.array(words), *sums], ["chunk", "bucket", "words", "background", "target"])

    return asked.groupBy("bucket").applyInArrow(run, "chunk bigint, bucket bigint, words bigint, background binary, target binary")


def score(documents: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, target_loss, background_loss, score)`` of every row; losses are nats per word.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. ``target_ids`` has the ids of the target
    documents in its first column; ids that no document has and nulls play no part. Null, empty and
    blank texts have no tokens and null losses. Without target documents the target model is uniform.
    Rows are handled one by one: repeated rows count and are returned repeatedly, a null id stays null;
    other columns play no part.
    """
    target = staged(target_ids.select(F.col(target_ids.columns[0]).alias("id")).where("id is not null").distinct(), "target-ids")
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = staged(_packed(rows.join(sized(target.withColumn("target", F.lit(True))), "id", "left")), "lm-chunks")
    n, n_target = (x or 0 for x in chunks.agg(F.sum("n"), F.sum("n_target")).first())
    answers = staged(_answered(_asked(chunks, max(LEAST_BUCKETS, n // BUCKET_WORDS))), "lm-counts")
    words = answers.agg(F.sum("words")).first()[0] or 0

    def run(chunk, found):
        found = found.sort_by("bucket")
        counts = [np.concatenate([np.zeros(0, dtype=np.int64), *(_numbers(x.as_py(), "<i8") for x in found[c])]) for c in ("target", "background")]
        out = []
        for r in range(chunk.num_rows):
            row = {c: chunk[c][r] for c in ("ids", "lengths", "names", "places")}
            lengths = np.asarray(row["lengths"].values)
            grams, some = Grams(row["names"].as_py(), row["places"].as_py(), lengths), lengths > 0
            losses = []
            for seen, total in zip(counts, (n_target, n)):
                mean = np.zeros(len(lengths))
                if some.any():
                    alone = (seen[grams.word] + BACKOFF / words) / (total + BACKOFF)
                    loss = -np.log((seen[grams.pair] + BACKOFF * alone) / (seen[grams.before] + BACKOFF))
                    mean[some] = np.add.reduceat(loss, grams.heads) / lengths[some]
                losses.append(mean)
            out.append(
                pa.table(
                    [row["ids"].values, pa.array(lengths), *[pa.array(x, mask=~some) for x in (*losses, losses[0] - losses[1])]],
                    ["id", "n_tokens", "target_loss", "background_loss", "score"],
                )
            )
        return pa.concat_tables(out)

    return (
        chunks.select("chunk", "ids", "lengths", "names", "places")
        .groupBy("chunk")
        .cogroup(answers.select("chunk", "bucket", "background", "target").groupBy("chunk"))
        .applyInArrow(run, f"id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")
    )


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; the documents labelled as good are the target."""
    good = labels.where(F.col("quality") == 1).select("doc_id")
    return score(documents, good).withColumnRenamed("id", "doc_id")
