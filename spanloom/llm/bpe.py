"""Byte-level BPE: merges folded by Spark's higher-order functions, and decoding.

Texts are cut into pieces (:mod:`pretoken`). A task lists every distinct piece once, as the array of
its bytes' ids; a fold over that array applies the ranked merges, looking pairs up in a literal map.
The same task then puts the ids of the pieces, and the bytes those ids stand for, together again for
each document. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import pretoken as P
from spanloom.llm import text as T

#: Pieces handed to the fold in one row, and distinct pieces after which a task starts a new list.
ROW_PIECES, LIST_PIECES = 1 << 18, 2_000_000
#: The rank map is split into this many small maps, found by a hash of the pair.
#: Spark's xxhash64 is XXH64 with this seed.
BUCKETS, HASH_SEED = 1 << 16, 42
#: The character of token 0; bytes have characters of two bytes in UTF-8, and no token has a surrogate.
FIRST_SYMBOL = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file: one base64 text and one number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The pair of ids that makes each token longer than a byte.

    A token's own bytes are merged by all lower ranks; what is left are its two parts.
    """
    pairs = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(options)
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs[ranks[parts[0]], ranks[parts[1]]] = rank
    return pairs


def _symbol(token: int) -> str:
    """The character that stands for a token while pieces are merged; bytes and all ids below 54 000 have one."""
    return chr(token + FIRST_SYMBOL)


def _rank_map(spark: SparkSession, merges: dict[tuple[int, int], int]) -> Column:
    """All merges as a literal: an array of maps from a pair of symbols to its rank, dealt by a hash of the pair."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for (a, b), rank in merges.items():
        pair = _symbol(a) + _symbol(b)
        buckets[xxhash.xxh64_intdigest(pair, HASH_SEED) % BUCKETS][pair] = rank
    return _literal(spark, buckets, "array<map<string,int>>")


def _pairs(spark: SparkSession, merges: dict[tuple[int, int], int], tokens: int) -> Column:
    """By rank: the pair of symbols that merges, and the symbol it becomes."""
    pairs = [{"pair": "", "made": ""} for _ in range(tokens)]
    for (a, b), rank in merges.items():
        pairs[rank] = {"pair": _symbol(a) + _symbol(b), "made": _symbol(rank)}
    return _literal(spark, pairs, "array<struct<pair:string,made:string>>")


def _token_bytes(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """By id: the bytes of the token, in hexadecimal."""
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex()
    return _literal(spark, tokens, "array<string>")


def _literal(spark: SparkSession, value, kind: str) -> Column:
    """A value of any size as a constant of the plan, whose text does not hold it."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return spark.createDataFrame([(text,)], "text string").select(F.from_json("text", kind)).scalar()


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(symbols: Column, at) -> Column:
    return F.ascii(F.substring(symbols, at, 1)) - FIRST_SYMBOL


def fold_merges(piece: Column, rank_map: Column, pairs: Column) -> Column:
    """The symbols of a piece's tokens, from the symbols of its bytes: the lowest rank merges first.

    The state holds the symbols ``s`` and the least rank ``m`` of two that stand together; a step
    merges all of those from the left, which can't make a pair of a lower rank.
    """

    def state(s):
        def rank(i):
            pair = F.substring(s, i, 2)
            return F.try_element_at(F.get(rank_map, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1))), pair)

        ranks = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s) - 1, F.lit(1))), rank)
        return F.struct(s.alias("s"), F.array_min(ranks).alias("m"))

    def step(x, _):
        merged = F.replace(x["s"], F.get(pairs, x["m"])["pair"], F.get(pairs, x["m"])["made"])
        return F.when(x["m"].isNull(), x).otherwise(_let(merged, state))

    turns = F.sequence(F.lit(1), F.greatest(F.char_length(piece) - 1, F.lit(1)))
    return F.aggregate(turns, state(piece), step)["s"]


def decode_symbols(symbols: Column, token_bytes: Column) -> Column:
    """The bytes of all tokens, one after the other."""
    parts = F.transform(F.sequence(F.lit(1), F.char_length(symbols)), lambda i: F.get(token_bytes, _number(symbols, i)))
    return F.unhex(F.array_join(parts, ""))


def _piece_rows(documents: DataFrame, byte_ids: np.ndarray) -> DataFrame:
    """Rows of documents with the number of their pieces, all pieces' codes, and new pieces in full."""
    kind = documents.schema[0].dataType.simpleString()

    def run(batches):
        lists, fresh = P.PieceCodes(), True
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            for a, z in T.chunks(offsets, ROW_PIECES * 4):
                if len(lists) > LIST_PIECES:
                    lists, fresh = P.PieceCodes(), True
                buf, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                starts, ends, rows = P.pattern_spans(buf, cut)
                codes, first = lists.add(T.span_names(buf, starts, ends))
                sizes = (ends - starts)[first]
                points = byte_ids[buf[P.ragged(starts[first], sizes)]] + FIRST_SYMBOL
                flat = np.column_stack([0xC0 | points >> 6, 0x80 | points & 0x3F]).astype(np.uint8)
                ends_of = np.append(0, np.cumsum(sizes * 2)).astype(np.int32)
                pieces = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends_of), pa.py_buffer(flat.tobytes()))
                ids = batch.column(0).slice(a, z - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fresh]),
                        pa.ListArray.from_arrays(np.array([0, z - a], dtype=np.int32), ids),
                        pa.array([np.diff(rows).astype("<i4").tobytes()], pa.binary()),
                        pa.array([codes.astype("<i4").tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(np.array([0, len(sizes)], dtype=np.int32), pieces),
                    ],
                    ["fresh", "ids", "counts", "codes", "pieces"],
                )
                fresh = False
        T.give_back_memory()

    return documents.mapInArrow(
        run, f"fresh boolean, ids array<{kind}>, counts binary, codes binary, pieces array<string>"
    )


def _document_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Puts the pieces' ids and bytes together, in the task that listed the pieces."""

    def run(batches):
        ids = data = id_sizes = data_sizes = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("fresh")[i].as_py():
                    ids, data = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint8)
                    id_sizes = data_sizes = np.zeros(0, dtype=np.int64)
                buf, cut = T.text_bytes(batch.column("tokens").slice(i, 1).flatten())
                heads = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
                points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int32)
                ids, id_sizes = np.append(ids, points - FIRST_SYMBOL), np.append(id_sizes, np.diff(heads[cut]))
                buf, cut = T.text_bytes(batch.column("bytes").slice(i, 1).flatten())
                data, data_sizes = np.append(data, buf), np.append(data_sizes, np.diff(cut))
                id_starts, data_starts = np.cumsum(id_sizes) - id_sizes, np.cumsum(data_sizes) - data_sizes

                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), dtype="<i4")
                ends = np.append(0, np.cumsum(np.frombuffer(batch.column("counts")[i].as_buffer(), dtype="<i4").astype(np.int64)))
                total = np.append(0, np.cumsum(id_sizes[codes]))[ends]
                own = ids[P.ragged(id_starts[codes], id_sizes[codes])].astype("<u4")
                bytes_total = np.append(0, np.cumsum(data_sizes[codes]))[ends]
                decoded = data[P.ragged(data_starts[codes], data_sizes[codes])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(i, 1).flatten(),
                        pa.array(np.diff(total)),
                        _binary(own, total * 4),
                        _binary(decoded, bytes_total),
                    ],
                    ["id", "n_tokens", "ids", "decoded"],
                )
        ids = data = id_sizes = data_sizes = None
        T.give_back_memory()

    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded binary")


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    )
    return whole.cast(pa.binary())


def encode_decode(documents: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` of every row: ids as little-endian 32-bit numbers, and the
    bytes that the ids stand for.

    Special tokens are not looked for. Null and empty texts have no ids. Rows are handled one by one:
    repeated rows give repeated results, a null id stays null; other columns play no part. A piece of
    ``n`` bytes takes time up to ``n`` squared. ``ranks_path`` is read on the driver only.
    """
    ranks = read_ranks(ranks_path)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
    if byte_ids.max() > 255:
        raise ValueError("single bytes must have the lowest ranks")
    if max(ranks.values()) + FIRST_SYMBOL >= 0xD800:
        raise ValueError("the vocabulary is too large for one character per token")
    kind = documents.schema[id_col].dataType.simpleString()
    rows = _piece_rows(documents.select(id_col, text_col), byte_ids)
    merges, spark = merges_of(ranks), documents.sparkSession
    rows = rows.withColumns({"rank_map": _rank_map(spark, merges), "pairs": _pairs(spark, merges, max(ranks.values()) + 1), "token_bytes": _token_bytes(spark, ranks)})
    tokens = F.transform("pieces", lambda p: fold_merges(p, F.col("rank_map"), F.col("pairs")))
    rows = rows.withColumn("tokens", tokens)
    decoded = F.transform("tokens", lambda s: decode_symbols(s, F.col("token_bytes")))
    rows = rows.select("fresh", "ids", "counts", "codes", "tokens", decoded.alias("bytes"))
    return _document_rows(rows, kind)


def token_digests(documents: DataFrame, ranks_path: str) -> DataFrame:
    """Counts of tokens and digests of ids and decoded bytes, one row per document."""
    return encode_decode(documents, ranks_path).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
