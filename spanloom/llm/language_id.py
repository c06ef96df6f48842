"""Language identification by compression with one dictionary for each language.

A dictionary is raw content: texts of a bounded labelled sample, in one language. A text is compressed
with every dictionary, in stretches that each begin with nothing but the dictionary, so that what the
right dictionary saves grows with the text; the language whose dictionary leaves the fewest bytes is
predicted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from spanloom.llm import pretoken as P
from spanloom.llm import text as T
from spanloom.llm.tables import sized
from spanloom.session import staged

#: The bounds of the sample: different texts of each language, and bytes of its dictionary.
TEXTS, DICTIONARY_BYTES = 512, 400_000
LEVEL = 6
#: Bytes of words compressed at once; all stretches of a text count.
STRETCH_BYTES = 20_000
#: What stands between words; a text is compressed as its lower-cased words, with one blank between.
BETWEEN = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Texts of which the two best sizes differ by less than this share of the better one are rejected.
NARROW = 0.002
ADDED = (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType()))
#: Nats of evidence that one byte counts as in the score.
BYTE_WEIGHT = 0.5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 1 when divided by 3.

    A null id is not kept out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_only(text: str) -> bytes:
    return BETWEEN.sub(" ", text.lower()).encode()


def _words(batches):
    for batch in batches:
        words = [words_only(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(words, pa.binary())], ["lang", "h", "words"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary of raw content for each language of ``labelled``.

    Of every language the ``TEXTS`` different texts with the smallest hashes are taken, and of those as
    many bytes as fit into the dictionary: an equal share of each, and what short texts leave over goes
    to longer ones. A text longer than its share gives one piece, at an offset by its hash. What is
    sampled depends on texts and labels only. Rows without label or text play no part.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= TEXTS)
    chosen = staged(chosen.drop("k"), "training-texts")
    texts = rows.join(sized(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts = staged(texts.mapInArrow(_words, f"lang {rows.schema['lang'].dataType.simpleString()}, h bigint, words binary"), "training-words")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(texts.select("lang", "h", F.length("words").alias("n")).collect()):  # TEXTS rows of each language at most
        found.setdefault(r.lang, []).append((r.h, r.n))
    cuts = []
    for lang, own in found.items():
        share = max(DICTIONARY_BYTES // len(own), 1)
        spare = DICTIONARY_BYTES - sum(min(n, share) for _, n in own)
        for h, n in own:
            more = min(max(n - share, 0), spare)
            spare -= more
            size = min(n, share) + more
            cuts.append((lang, h, h % (n - size + 1) + 1, size))
    if not cuts:
        return {}
    at = F.broadcast(texts.sparkSession.createDataFrame(cuts, f"lang {texts.schema['lang'].dataType.simpleString()}, h bigint, start int, size int"))
    pieces = texts.join(at, ["lang", "h"]).selectExpr("lang", "h", "substring(words, start, size) as piece")
    out: dict[str, list[bytes]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.lang, r.h)):  # DICTIONARY_BYTES of each language at most
        out.setdefault(r.lang, []).append(bytes(r.piece))
    return {lang: b"\n".join(parts) for lang, parts in out.items()}


def sizes(texts: list[bytes], dictionaries: dict[str, bytes], level: int = LEVEL) -> np.ndarray:
    """Compressed bytes of each text (rows) with each dictionary (columns), summed over its stretches."""
    import zstandard

    out = np.zeros((len(texts), len(dictionaries)), dtype=np.int64)
    for j, content in enumerate(dictionaries.values()):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
        for i, t in enumerate(texts):
            out[i, j] = sum(len(packer.compress(t[p : p + STRETCH_BYTES])) for p in range(0, max(len(t), 1), STRETCH_BYTES))
    return out


def predict(documents: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``documents`` with the columns ``lang_pred``, ``score`` and ``rejected`` instead of any so named.

    ``lang_pred`` is the language of the smallest compressed size (of equals the first by name), or
    ``und``, with score 0, if the text is null or has no letter or no language was learned. ``score``
    is the share of the winner when every byte of size counts ``BYTE_WEIGHT`` nats. Rows are rejected
    if they are ``und`` or the two best sizes are closer than ``NARROW``. Rows are handled one by one:
    repeated rows give repeated results, a null id stays null, other columns play no part.
    """
    names = sorted(dictionaries)
    shared = documents.sparkSession.sparkContext.broadcast({k: dictionaries[k] for k in names})
    documents = documents.drop("lang_pred", "score", "rejected")
    place = documents.columns.index(text_col)
    schema = StructType([*documents.schema, *(StructField(*f) for f in ADDED)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = T.text_bytes(batch.column(place))
            for a, z in T.chunks(offsets):
                lang = np.full(z - a, len(names))
                score, reject = np.zeros(z - a), np.ones(z - a, dtype=bool)
                buf, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                letters = np.append(0, np.cumsum(P.byte_classes(buf) == P.LETTER))[cut]
                some = np.flatnonzero(np.diff(letters)) if names else np.zeros(0, dtype=np.int64)
                if len(some):
                    packed = sizes([words_only(buf[cut[i] : cut[i + 1]].tobytes().decode()) for i in some], shared.value)
                    best = packed.min(axis=1, keepdims=True)
                    weight = np.exp(-BYTE_WEIGHT * (packed - best))
                    lang[some] = packed.argmin(axis=1)
                    score[some] = 1.0 / weight.sum(axis=1)
                    if len(names) > 1:
                        second = np.partition(packed, 1, axis=1)[:, 1]
                        reject[some] = second - best[:, 0] < NARROW * best[:, 0]
                    else:
                        reject[some] = False
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, z - a).columns, pa.array([*names, UNKNOWN]).take(pa.array(lang)), pa.array(score), pa.array(reject)],
                    [*batch.schema.names, "lang_pred", "score", "rejected"],
                )
        T.give_back_memory()

    return documents.mapInArrow(run, schema)


def language_report(documents: DataFrame) -> DataFrame:
    """Prediction and score of every document, learned from those that aren't held out."""
    dictionaries = fit(documents.where(~held_out(F.col("doc_id"))))
    return predict(documents.select("doc_id", "text"), dictionaries).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def drop_rejected(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``documents`` without the rows whose language isn't clear; all else stays as it is."""
    dictionaries = fit(documents.where(~held_out(F.col(id_col))), text_col, lang_col)
    return predict(documents, dictionaries, text_col).where("not rejected").select(documents.columns)
