"""Words of Arrow text columns as numpy arrays: spans, 64-bit names, per-document ranges."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes handled at once inside a task; one longer document is handled alone.
CHUNK_BYTES = 2 << 20
#: Words above this many bytes are named by one xxhash call instead of 8-byte steps.
LONG_WORD = 256

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def give_back_memory() -> None:
    """Returns what Arrow and the C library keep for later use; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def separators(chars: bytes) -> np.ndarray:
    """A 256-entry table that is true at the given ASCII bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


IS_SPACE = separators(WHITESPACE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(off) == 0 or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes; every range has a row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, rows)
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal separator-free runs of each row, and each row's range of words."""
    sep = is_sep[buf]
    before = np.empty(len(buf) + 1, dtype=bool)
    before[1:] = sep
    before[0] = True
    after = before.copy()
    after[:-1] = sep
    after[-1] = True
    cuts = offsets[1:-1]
    first, last = before[:-1], after[1:]
    first[cuts[cuts < len(buf)]] = True
    last[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(first & ~sep)
    ends = np.flatnonzero(last & ~sep) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name for the bytes of each span; equal bytes have equal names in every task."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    names = mix(length.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    live = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    at = 0
    while len(live):
        left = np.minimum(length[live] - at, 8).astype(U64)
        part = eight[starts[live] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - left) * U64(8)))
        names[live] = mix(names[live] ^ (part * U64(0x9E3779B97F4A7C15)))
        at += 8
        live = live[length[live] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        names[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return names


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, dtype=U64), np.full(size, pow(base, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
        if size <= 1 << 20:
            _POWERS[base] = have
    return have


class BlockNames:
    """Names of blocks of consecutive words, from prefix sums over the words' names."""

    def __init__(self, names: np.ndarray, base: int):
        self.up, self.down = _powers(base, len(names) + 1)
        self.sums = np.zeros(len(names) + 1, dtype=U64)
        np.cumsum(names * self.up[: len(names)], out=self.sums[1:])

    def name(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])
