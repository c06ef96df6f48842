"""Token ids in ORC files: written in the order of document ids, read back stripe by stripe.

Layout: one folder for each range of ids (``part=0``, ``part=1``, ...), rows sorted by id inside. ORC
run-length-encodes the ids of a stripe and keeps least and greatest values and a Bloom filter of the
document ids for every stripe and row group, so a look-up by id skips what it doesn't need.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm import pretoken as P
from spanloom.llm import text as T
from spanloom.session import new_shared_path, staged

END_ID = 2
#: Distinct pieces after which a task forgets their ids.
LIST_PIECES = 2_000_000

_READY: dict[int, object] = {}


def _tokenizer(text: str):
    """The tokenizer of a vocabulary file's text, made once in each Python worker."""
    key = hash(text)
    if key not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _READY[key] = Tokenizer.from_str(text)
    return _READY[key]


class PieceIds:
    """Ids of all pieces met so far; only new pieces are given to the tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self):
        self.seen = P.PieceCodes()
        self.ids, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def encode(self, buf: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and each row's range of them."""
        starts, ends, rows = P.pattern_spans(buf, cut)
        if len(self.seen) > LIST_PIECES:
            self.clear()
        codes, first = self.seen.add(T.span_names(buf, starts, ends))
        if len(first):
            new = [buf[s:e].tobytes().decode() for s, e in zip(starts[first], ends[first])]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.ids = np.append(self.ids, np.array([i for ids in found for i in ids], dtype=np.int32))
            self.sizes = np.append(self.sizes, np.array([len(ids) for ids in found], dtype=np.int64))
        begin = np.cumsum(self.sizes) - self.sizes
        ids = self.ids[P.ragged(begin[codes], self.sizes[codes])]
        return ids, np.append(0, np.cumsum(self.sizes[codes]))[rows]


def encode(documents: DataFrame, vocabulary: str, special: list[str], end_id: int, cuts: list) -> DataFrame:
    """``(part, id, ids)`` of every row: its range of ids, its id, its tokens with the end id.

    A text that holds a special token's string is given to the tokenizer whole, all others by piece.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = documents.schema[0].dataType.simpleString()

    def run(batches):
        tokenizer = _tokenizer(shared.value)
        pieces = PieceIds(tokenizer)
        bounds = np.array(cuts, dtype=np.int64)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            odd = np.zeros(len(texts), dtype=bool)
            for s in special:
                odd |= np.asarray(pc.match_substring(texts, s))
            data, offsets = T.text_bytes(texts)
            names = batch.column(0)
            part = np.searchsorted(bounds, np.asarray(names.fill_null(np.iinfo(np.int64).min).cast(pa.int64())), side="left")
            for a, z in T.chunks(offsets):
                buf, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                ids, at = pieces.encode(buf, cut)
                rows = [ids[at[i] : at[i + 1]] for i in range(z - a)] if odd[a:z].any() else None
                if rows is not None:
                    for i in np.flatnonzero(odd[a:z]):
                        whole = tokenizer.encode(texts[int(a + i)].as_py(), add_special_tokens=False).ids
                        rows[i] = np.array(whole, dtype=np.int32)
                    ids, at = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[a:z].astype(np.int32)),
                        names.slice(a, z - a),
                        pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32)),
                    ],
                    ["part", "id", "ids"],
                )

    return documents.mapInArrow(run, f"part int, id {kind}, ids array<int>")


def write_tokens(
    documents: DataFrame, vocabulary_path: str, path: str, parts: int | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the tokens of all rows to ``path`` in the order of their ids, which are whole numbers.

    Each text is encoded by the tokenizers library without added special tokens and ends with
    ``end_id``; null and empty texts hold the end id only. Repeated ids stand next to each other, a
    null id comes first. ``parts`` ranges of about equal numbers of rows are written (by default as
    many as Spark shuffles to). ``vocabulary_path`` is read on the driver only.
    """
    import json

    spark = documents.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    special = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / parts for i in range(1, parts)] or [0.5]
    cuts = documents.agg(F.percentile_approx(id_col, share, 100 * parts)).first()[0] or []
    rows = encode(documents.select(id_col, text_col), vocabulary, special, end_id, sorted(set(cuts)) if parts > 1 else [])
    (
        rows.repartition(parts, "part")
        .sortWithinPartitions("part", "id")
        .write.partitionBy("part")
        .option("orc.bloom.filter.columns", "id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``(id, ids, part)`` of the rows in the files; filters on ``id`` and ``part`` prune them."""
    return spark.read.schema(f"id {kind}, ids array<int>, part int").orc(path)


def document_index(tokens: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every row of the files.

    ``start`` counts the ids of all rows before, in the order of ids (rows that share an id: by
    length, then checksum). The sums of the parts, one number each, pass the driver.
    """
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, sizes = np.asarray(lists.flatten()).astype("<u4"), np.asarray(lists.value_lengths()).astype(np.int64)
            data, ends = memoryview(values).cast("B"), np.append(0, np.cumsum(sizes)) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("id"), pa.array(sizes), pa.array(np.array(sums, dtype=np.int64))],
                ["part", "id", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("part", "id", "ids").mapInArrow(run, f"part int, id {kind}, n_tokens bigint, ids_crc32 bigint")
    rows = staged(rows, "token-rows")
    sums = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part int, before bigint")
    order = Window.partitionBy("part").orderBy("id", "n_tokens", "ids_crc32")
    running = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("running", running)
        .join(F.broadcast(offsets), "part")
        .select("id", (F.col("before") + F.col("running") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """Writes the documents' tokens to the shared folder and reports what the files hold."""
    spark = documents.sparkSession
    path = new_shared_path(spark, "token-files")
    write_tokens(documents, vocabulary_path, path)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return document_index(read_tokens(spark, path, kind)).withColumnRenamed("id", "doc_id")
