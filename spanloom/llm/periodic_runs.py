"""Maximal periodic runs of words, by block convolution.

Periods are searched by powers of two. A run with a period from ``D`` to ``2 D`` holds a whole block of
the text's grid of blocks, and its repetition one period later. So every block is compared with the
window that starts ``D`` words later: an exact number-theoretic transform gives the sum of squared
differences at each distance, which is zero where the block occurs. These distances are the periods
to extend, word by word, to the longest stretch. Blocks of which a word doesn't recur in the window have
no occurrence and are left out before the transform.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as T
from spanloom.llm.tables import map_batches

#: Shortest run, in words; a run has two periods at least.
LEAST = 12
#: A prime with roots of unity of order 2**23, and a generator of its residues.
PRIME, GENERATOR = 998244353, 3
#: Distances covered by one transform at most, and numbers transformed at once.
REACH, AT_ONCE = 1 << 21, 1 << 20
#: Word pairs compared at once when periods are extended.
EXTEND_AT_ONCE = 1 << 22

P = T.U64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // P * P


def _powers(root: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=T.U64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _mod(out[:more] * T.U64(pow(root, have, PRIME)))
        have += more
    return out


def ntt(a: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Transform of each row (a power of two long), in bit-reversed order; the inverse takes that order back."""
    rows, n = a.shape
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    powers = _powers(pow(root, -1, PRIME) if inverse else root, max(n // 2, 1))
    a = a.copy()
    half = 1 if inverse else n // 2
    while 0 < half < n:
        pairs, turn = a.reshape(rows, -1, 2, half), powers[:: n // (2 * half)]
        u, v = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        if inverse:
            v = _mod(v * turn)
        total, less = u + v, u + P - v
        pairs[:, :, 0] = np.where(total >= P, total - P, total)
        pairs[:, :, 1] = np.where(less >= P, less - P, less) if inverse else _mod(less * turn)
        half = half * 2 if inverse else half // 2
    return _mod(a * T.U64(pow(n, -1, PRIME))) if inverse else a


def block_length(first: int, least: int = LEAST) -> int:
    """Words of a block such that every run with a period of ``first`` to ``2 first`` holds one and its repetition.

    Leaving out its last period, a run has ``max(least, 2 q) - q`` words, and any stretch of
    ``2 b - 1`` words holds a whole block of ``b``.
    """
    return (min(max(least, 2 * q) - q for q in range(first, max(min(2 * first, least), first + 1))) + 1) // 2


def occurrences(values: np.ndarray, squares: np.ndarray, blocks: np.ndarray, length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by index) and distances from ``first`` to ``last`` (exclusive) at which the squared differences sum up to zero.

    ``values`` are the words' numbers, a zero behind the last one; ``squares`` the running sums of their squares.
    """
    found, at = [], []
    for low in range(first, last, REACH):
        reach = min(REACH, last - low)
        n = 1 << (reach + length - 2).bit_length() if reach + length > 2 else 1
        size = max(1, AT_ONCE // n)
        for k in range(0, len(blocks), size):
            start = blocks[k : k + size, None]
            block = np.zeros((len(start), n), dtype=T.U64)
            block[:, :length] = values[start + np.arange(length - 1, -1, -1)]
            window = np.zeros((len(start), n), dtype=T.U64)
            window[:, : reach + length - 1] = values[np.minimum(start + low + np.arange(reach + length - 1), len(values) - 1)]
            shared = ntt(_mod(ntt(block) * ntt(window)), inverse=True)[:, length - 1 : length - 1 + reach]
            there = np.minimum(start + low + np.arange(reach + 1), len(squares) - 1)
            there_end = np.minimum(there + length, len(squares) - 1)
            own = squares[start + length] - squares[start]
            both = own + (squares[there_end] - squares[there])[:, :reach]
            row, distance = np.nonzero(_mod(both) == _mod(shared * T.U64(2)))
            found.append(row + k)
            at.append(distance + low)
    return np.concatenate(found), np.concatenate(at)


class _Known:
    """Runs found so far: which of those with a period up to a bound reaches farthest from a word."""

    def __init__(self, runs: np.ndarray, most: int):
        runs = runs[runs[:, 2] <= most]
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        ends = runs[:, 0] + runs[:, 1]
        best = np.maximum.accumulate(np.where(ends == np.maximum.accumulate(ends), np.arange(len(ends)), 0)) if len(ends) else ends
        self.starts = runs[:, 0]
        self.ends, self.periods = np.append(ends[best], 0), np.append(runs[best, 2], 1)

    def reach(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.starts, places, side="right") - 1
        return self.ends[at], self.periods[at]  # index -1 is the entry that reaches nowhere


def _stretches(words: np.ndarray, texts: np.ndarray, distances: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """``(start, length, period)`` of the longest stretches of the given texts that repeat at the given distances."""
    out, low = [], bounds[texts]
    counts = bounds[texts + 1] - low - distances
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXTEND_AT_ONCE, side="right")))
        n, d = counts[at:to], distances[at:to]
        heads = np.cumsum(n) - n
        place = np.arange(int(n.sum())) + np.repeat(low[at:to] - heads, n)
        same = words[place] == words[place + np.repeat(d, n)]
        before = np.append(False, same[:-1])
        before[heads[n > 0]] = False
        after = np.append(same[1:], False)
        after[(heads + n - 1)[n > 0]] = False
        begin, end = np.flatnonzero(same & ~before), np.flatnonzero(same & ~after) + 1
        period = np.repeat(d, n)[begin]
        length = end - begin + period
        keep = length >= np.maximum(least, 2 * period)
        out.append(np.stack([place[begin[keep]], length[keep], period[keep]], axis=1))
        at = to
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def word_runs(names: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``(start, length, period)`` of all runs of all texts, by start, then period.

    ``names`` are the words' names, text ``k`` has the words ``bounds[k]`` to ``bounds[k + 1]``; starts
    count over all texts. A run is a longest stretch with its smallest period, ``max(least, 2 period)``
    words long at least.
    """
    n = len(names)
    runs = np.zeros((0, 3), dtype=np.int64)
    longest = int(np.diff(bounds).max(initial=0))
    if longest < least:
        return runs
    words = np.unique(names, return_inverse=True)[1].astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][text]
    # The places of each word stand together in order, so the next place from a given one on is found by bisection.
    places = np.sort(words * (n + 1) + np.arange(n))
    places = np.append(places, np.iinfo(np.int64).max)
    values = np.append(names % P, T.U64(0))
    squares = np.append(T.U64(0), np.cumsum(_mod(values * values)[:-1], dtype=T.U64))

    def recurs(at, first, last):
        own = words[at] * (n + 1)
        found = places[np.searchsorted(places, own + at + first)]
        return found < own + np.minimum(at + last, ends[at])

    first = 1
    while 2 * first <= longest:
        length, last = block_length(first, least), 2 * first
        blocks = np.arange(0, n - length + 1, length)
        blocks = blocks[blocks + length + first <= ends[blocks]]
        known = _Known(runs, length)
        # A block whose window lies in a run of a shorter period repeats only at multiples of that period.
        blocks = blocks[known.reach(blocks)[0] < blocks + length + last]
        low, high = 0, 1
        while low < length and len(blocks):
            words_at = blocks[:, None] + np.arange(low, min(high, length))
            blocks = blocks[recurs(words_at.reshape(-1), first, last).reshape(words_at.shape).all(axis=1)]
            low, high = high, high * 8
        if len(blocks):
            row, distance = occurrences(values, squares, blocks, length, first, last)
            start = blocks[row]
            inside = start + length + distance <= ends[start]
            end, period = known.reach(start)
            again = (start + length + distance <= end) & (distance % period == 0)
            pairs = np.unique(np.stack([text[start], distance], axis=1)[inside & ~again], axis=0)
            more = _stretches(words, pairs[:, 0], pairs[:, 1], bounds, least)
            runs = np.concatenate([runs, more])
            # A stretch that was found with several periods is the run of the smallest.
            runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
            fresh = np.ones(len(runs), dtype=bool)
            fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
            runs = runs[fresh]
        first *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def later_periods(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows, the bytes of their texts, the starts, ends and names of their words, and each row's range of words."""
    data, offsets = T.text_bytes(batch.column("text"))
    for a, z in T.chunks(offsets):
        buf = data[offsets[a] : offsets[z]]
        starts, ends, rows = T.word_spans(buf, offsets[a : z + 1] - offsets[a], T.IS_SPACE)
        yield a, z, buf.tobytes(), starts, ends, T.span_names(buf, starts, ends), rows


def _joined(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([buf[p:q] for p, q in zip(starts.tolist(), ends.tolist())])


def periodic_runs(documents: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, length, period)``: one row per run of each document, in words numbered from 0.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null, empty and blank texts have no runs. Documents
    are handled row by row and whole, whatever their length: repeated rows give their runs repeatedly,
    a null id stays null, other columns play no part.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def rows_of(batch):
        for a, _, _, _, _, names, rows in _chunks(batch):
            runs = word_runs(names, rows, least)
            text = np.searchsorted(rows, runs[:, 0], side="right") - 1
            columns = [runs[:, 0] - rows[text], runs[:, 1], runs[:, 2]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(a + text)), *map(pa.array, columns)], ["id", "start", "length", "period"]
            )

    return map_batches(rows, rows_of, f"id {kind}, start bigint, length bigint, period bigint")


def collapse_runs(documents: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """``documents`` in which every run keeps its first period only; other texts stay as they are.

    A word goes if any run holds it after its first period; the words that stay are joined by one space.
    """
    schema, columns = documents.schema, documents.columns
    place = columns.index(text_col)

    def rows_of(batch):
        batch = batch.rename_columns(["text" if i == place else f"c{i}" for i in range(len(columns))])
        texts = batch.column("text").to_pylist()
        for a, z, buf, starts, ends, names, rows in _chunks(batch):
            runs = word_runs(names, rows, least)
            kept = ~later_periods(runs, len(names))
            for i in np.unique(np.searchsorted(rows, runs[:, 0], side="right") - 1).tolist():
                own = np.arange(rows[i], rows[i + 1])[kept[rows[i] : rows[i + 1]]]
                texts[a + i] = _joined(buf, starts[own], ends[own]).decode()
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns)], [f.name for f in schema]
        )

    return map_batches(documents, rows_of, schema)


def repeated_words(ids: list, rows: np.ndarray) -> np.ndarray:
    """Of each word of the report, the word of the text that stands for it.

    With ``h`` the CRC-32 of the decimal id and ``g = h // 10``, texts with ``h % 10 == 0`` repeat, from
    word ``a = g % n`` on, the ``1 + (n - a) // (3 + g % 8)`` words that begin there. Texts without id stay.
    """
    place = np.arange(rows[-1])
    for i, name in enumerate(ids):
        low, n = int(rows[i]), int(rows[i + 1] - rows[i])
        g, rest = divmod(zlib.crc32(str(name).encode()), 10)
        if n and rest == 0 and name is not None:
            a = g % n
            place[low + a : low + n] = low + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


def run_report(documents: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, one row per document.

    The words are those of :func:`repeated_words`; nulls, empty texts and repeated rows are handled as in
    :func:`periodic_runs`. Of the longest runs the one with the smallest start, then period, is given.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def rows_of(batch):
        ids = batch.column("doc_id").to_pylist()
        for a, z, buf, starts, ends, names, rows in _chunks(batch):
            place = repeated_words(ids[a:z], rows)
            runs = word_runs(names[place], rows)
            kept = ~later_periods(runs, len(names))
            at = np.searchsorted(runs[:, 0], rows)
            out = []
            for i in range(z - a):
                own = runs[at[i] : at[i + 1]] - [rows[i], 0, 0]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
                s, n, q = own[np.argmax(own[:, 1])].tolist() if len(own) else (None, None, None)
                words = place[rows[i] : rows[i + 1]][kept[rows[i] : rows[i + 1]]]
                text = _joined(buf, starts[words], ends[words])
                out.append((len(own), s, n, q, n and 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            names_of = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, z - a), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], ["doc_id", *names_of]
            )

    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return map_batches(documents.select("doc_id", "text"), rows_of, schema)
