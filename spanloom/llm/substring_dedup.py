"""Removal of long word sequences that a document with a smaller id holds too.

Method: recompression. Rounds of run and pair naming turn all documents into symbols of several levels; a
symbol's name follows from its words alone, so every task names equal runs and pairs equally and no round
needs a shuffle. The symbols that a window may share with what stands outside of it are taken away level by
level; those left inside, and those taken away, are the same for all equal windows. High-level symbols reveal
the repeats: a window's key is the least name of five neighbouring symbols at the highest level that leaves
it so many. Keys found in one document only need no more work. Symbols verify the others: runs of windows,
then single windows, are compared by the names of the symbols taken away at each level and of those left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import recompression as R
from spanloom.llm import text as T
from spanloom.llm.tables import keep_keys, map_batches, order_of, row_key, unique_rows
from spanloom.session import staged

WINDOW = 50
#: Words parsed at once; longer documents are parsed in stretches that overlap by a window.
STRETCH = 1 << 17
#: Odd multipliers of the block names.
KEY_BASE, FULL_BASES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_PLACE = T.U64((1 << 22) - 1)
#: An anchor is a symbol with this many neighbours on either side.
REACH = 2


def _stretches(rows: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words, with the rows they belong to, of at most ``STRETCH`` words each."""
    first, count = 0, len(rows) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(rows, rows[first] + STRETCH, side="right")) - 1)
        lo, hi = int(rows[first]), int(rows[last])
        if hi - lo <= STRETCH:
            yield lo, hi, first, last
        else:
            for at in range(lo, hi - window + 1, STRETCH - window + 1):
                yield at, min(at + STRETCH, hi), first, last
        first = last


def _range_min(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of each range, none of which is empty."""
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    out, have = np.empty(len(low), dtype=v.dtype), v
    for k in range(int(power.max()) + 1):
        if k:
            have = np.minimum(have[: -(1 << (k - 1))], have[1 << (k - 1) :])
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(have[low[at]], have[high[at] - (1 << k)])
    return out


def anchors(words: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: key, block name, row, first word in the row, windows.

    ``rows`` holds each row's range of ``words``. A window rises to its highest level that leaves it
    ``2 * REACH + 1`` symbols of its own; its key is the least name of so many symbols in a row there.
    The block name is that of the run's words, by symbols too.
    """
    out = []
    for lo, hi, first, last in _stretches(rows, window):
        part, cut = words[lo:hi], np.clip(rows[first : last + 1], lo, hi) - lo
        if len(part) < window:
            continue
        row = np.repeat(np.arange(first, last), np.diff(cut))
        end = cut[row - first + 1]
        window_at = np.flatnonzero(np.arange(len(part)) + window <= end)
        if not len(window_at):
            continue
        symbols = R.Symbols(part, cut[:-1])
        level, low, high, _ = symbols.uncross(window_at, window_at + window, 2 * REACH + 1)
        key, place = np.empty(len(level), dtype=T.U64), np.empty(len(level), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            heads = np.arange(len(symbols.names[k]) - 2 * REACH)
            names = T.mix(symbols.sequence(int(k), KEY_BASE).name(heads, heads + 2 * REACH + 1) + T.U64(k))
            least = _range_min((names & ~_PLACE) | heads.astype(T.U64), low[at], high[at] - 2 * REACH)
            least = (least & _PLACE).astype(np.int64)
            key[at], place[at] = names[least], symbols.starts[k][least]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (level[1:] != level[:-1]) | (window_at[1:] != window_at[:-1] + 1)
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(place)))
        start = window_at[heads]
        _, _, _, (block,) = symbols.uncross(start, start + count + window - 1, 1, (KEY_BASE,))
        # the first word of the run relative to its anchor is part of what the block stands for
        block = T.mix(block + (place[heads] - start).astype(T.U64))
        out.append((key[heads], block, row[start], start + lo - rows[row[start]], count))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(T.U64), empty.astype(T.U64), empty, empty, empty
    return tuple(np.concatenate(column) for column in zip(*out))


def _named(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its first row, bytes, word starts and ends, ranges of words, names."""
    data, offsets = T.text_bytes(batch.column(text_col))
    for a, z in T.chunks(offsets):
        buf, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        starts, ends, rows = T.word_spans(buf, cut, T.IS_SPACE)
        yield a, buf, starts, ends, rows, T.span_names(buf, starts, ends)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(documents: DataFrame, window: int, with_place: bool) -> DataFrame:
    kind = documents.schema[0].dataType.simpleString()
    schema = f"key bigint, id {kind}" + (", block bigint, first bigint, n int" if with_place else "")

    def rows_of(batch):
        for a, _, _, _, rows, names in _named(batch, "text"):
            key, block, row, first, n = anchors(names, rows, window)
            columns = [_signed(key), batch.column("id").take(pa.array(row + a))]
            if with_place:
                columns += [_signed(block), pa.array(first), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return map_batches(documents, rows_of, schema)


def _window_names(words: np.ndarray, rows: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """Two names by symbols for each of the windows that start at the words ``at``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    names = [np.zeros(len(at), dtype=T.U64) for _ in FULL_BASES]
    for lo, hi, first, last in _stretches(rows, window):
        a, b = np.searchsorted(at, [lo, max(lo, hi - window + 1)])
        if a == b:
            continue
        cut = np.clip(rows[first : last + 1], lo, hi) - lo
        symbols = R.Symbols(words[lo:hi], cut[:-1])
        _, _, _, found = symbols.uncross(at[a:b] - lo, at[a:b] - lo + window, 1, FULL_BASES)
        for name, part in zip(names, found):
            name[order[a:b]] = part
    return names


def _window_rows(texts: DataFrame, window: int) -> DataFrame:
    """Both names of every window in the given runs."""
    kind = texts.schema["id"].dataType.simpleString()

    def rows_of(batch):
        for a, _, _, _, rows, names in _named(batch, "text"):
            runs = batch.column("runs").slice(a, len(rows) - 1)
            lengths = np.asarray(runs.value_lengths())
            flat = runs.flatten()
            first, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(len(lengths)), lengths)
            start = rows[row] + first
            at = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            of = np.repeat(row, n)
            one, two = _window_names(names, rows, at, window)
            yield pa.RecordBatch.from_arrays(
                [_signed(one), _signed(two), batch.column("id").take(pa.array(of + a)), pa.array(at - rows[of])],
                ["w1", "w2", "id", "first"],
            )

    return map_batches(texts, rows_of, f"w1 bigint, w2 bigint, id {kind}, first bigint")


def repeated_windows(documents: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Runs of windows whose words also start in a row with a smaller id, and the texts they are in.

    ``documents`` has ``id`` (unique, or a :func:`tables.row_key`) and ``text``. Returns ``(id, first, n)``: the ``n`` windows
    that start at word ``first`` and after, and ``(id, text)`` of all rows with a shared anchor.
    """
    if window - 2 * R.margin() + 1 < R.longest_symbol():
        raise ValueError(f"windows of {window} words are too short for these rounds")

    def own(column):
        return order_of(documents, "id", column)

    shared = staged(
        _anchor_rows(documents, window, False)
        .groupBy("key")
        .agg(F.min("id").alias("least"), F.max("id").alias("most"))
        .where("least < most")
        .select("key"),
        "shared-anchors",
    )
    runs = staged(keep_keys(_anchor_rows(documents, window, True), shared, ["key"]), "anchor-runs")
    texts = staged(
        keep_keys(documents, staged(runs.select("id").distinct(), "anchored-ids"), ["id"]), "anchored-texts"
    )
    # Runs that agree word for word are settled together: all but the smallest id repeat it.
    # (The sums are written first: a join right above an aggregate can't split a hot partition.)
    by_block = staged(runs.groupBy("key", "block").agg(F.min("id").alias("least")), "block-ids")
    settled = staged(
        runs.join(by_block, ["key", "block"]).select("key", "id", "first", "n", (own("id") > own("least")).alias("repeats")),
        "settled-runs",
    )
    # What is left differs at one end: one row of each kind of run stands for it, window by window.
    several = staged(
        runs.groupBy("key").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("key"), "several-blocks"
    )
    open_runs = (
        keep_keys(settled.where("not repeats"), several, ["key"])
        .groupBy("id")
        .agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    )
    windows = staged(_window_rows(texts.join(open_runs, "id"), window), "windows")
    by_window = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    by_window = staged(by_window.where("least < most").drop("most"), "window-ids")
    late = windows.join(by_window, ["w1", "w2"]).where(own("id") > own("least")).select("id", "first", F.lit(1).alias("n"))
    return settled.where("repeats").select("id", "first", "n").unionByName(late), texts


def _joined_words(buf, starts, ends, rows, kept) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every row with one space between them, as bytes and offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(kept)
    inner = np.zeros(len(at), dtype=bool)
    inner[:-1] = row[at[1:]] == row[at[:-1]]
    size = (ends - starts)[at] + inner
    offsets = np.zeros(len(rows), dtype=np.int64)
    np.add.at(offsets, row[at] + 1, size)
    step = np.zeros(len(buf) + 1, dtype=np.int32)
    np.add.at(step, starts[at], 1)
    np.add.at(step, ends[at], -1)
    take = np.cumsum(step[:-1]) > 0
    spaces = ends[at[inner]]  # the separator that ended the word
    take[spaces] = True
    out = buf.copy()
    out[spaces] = 0x20
    return out[take], np.cumsum(offsets)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def word_texts(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of each row: the words outside of its ``runs`` of windows.

    ``documents`` has ``id``, ``text`` and, if words are to go, ``runs`` (array of first, n; may be null).
    """
    kind = documents.schema["id"].dataType.simpleString()
    has_runs = "runs" in documents.columns

    def rows_of(batch):
        data, offsets = T.text_bytes(batch.column("text"))
        for a, z in T.chunks(offsets):
            buf, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
            starts, ends, rows = T.word_spans(buf, cut, T.IS_SPACE)
            kept = np.ones(len(starts), dtype=bool)
            if has_runs:
                runs = batch.column("runs").slice(a, z - a)
                lengths = np.asarray(runs.value_lengths().fill_null(0))
                flat = runs.flatten()
                first, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
                begin = np.repeat(rows[:-1], lengths) + first
                step = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + n + window - 1, -1)
                kept = np.cumsum(step[:-1]) == 0
            lost = np.append(0, np.cumsum(~kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(a, z - a),
                    pa.array(np.diff(rows)),
                    pa.array(np.diff(lost[rows])),
                    _strings(*_joined_words(buf, starts, ends, rows, kept)),
                ],
                ["id", "n_words", "n_removed", "kept"],
            )

    return map_batches(documents, rows_of, f"id {kind}, n_words bigint, n_removed bigint, kept string")


def find_repeats(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of the documents that lose words.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``window`` consecutive words that
    covers it also starts in a document with a smaller id; windows are those of the input. ``kept``
    is the rest, joined by single spaces. A null or empty text has no words, a text shorter than the
    window loses none, repeats inside one document stay. Of rows that share an id one is used (see
    :func:`tables.unique_rows`); rows without an id are left out. Other columns play no part. Ids may
    be of any type with an order. Windows are compared by 128 bits of their words' names.
    """
    return _find(unique_rows(documents, id_col, text_col).toDF("id", "text"), window)


def _find(documents: DataFrame, window: int) -> DataFrame:
    runs, texts = repeated_windows(documents, window)
    by_row = runs.groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    return word_texts(texts.join(by_row, "id"), window)


def word_digests(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's counts of words and removed words, and the SHA-256 of what it keeps."""
    rows = unique_rows(documents, id_col, text_col).toDF("id", "text")
    lost = staged(_find(rows, window).select("id", "n_removed", F.sha2("kept", 256).alias("cut")), "cut-documents")
    whole = word_texts(rows).select("id", "n_words", F.sha2("kept", 256).alias("whole"))
    return whole.join(lost, "id", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("cut", "whole").alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the text of those that lose words replaced by the words they keep.

    All rows and columns stay, also texts of which nothing is left; those are empty. Every row is judged
    by its own text, also rows that share an id (none of them has the smaller one); rows without id
    stay as they are.
    """
    keyed = documents.withColumn("__row", row_key(documents, id_col, text_col))
    lost = find_repeats(keyed, window, "__row", text_col).select(F.col("id").alias("__lost"), F.col("kept").alias("__kept"))
    joined = keyed.join(staged(lost, "cut-texts"), F.col("__row") == F.col("__lost"), "left")
    return joined.select(
        *[F.coalesce("__kept", c).alias(c) if c == text_col else F.col(c) for c in documents.columns]
    )
