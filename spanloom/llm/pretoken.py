"""The pieces that byte-level tokenizers merge within, found for many texts at once.

The pattern of the public byte-level vocabularies,
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, cuts a text where
the class of its characters changes, lets one blank join the run after it, and cuts the English
endings off an apostrophe. Here the cuts are computed on arrays of character classes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Fixed values of the pattern: endings after an apostrophe, of one and of two letters.
SHORT_ENDINGS, LONG_ENDINGS = b"stmd", (b"re", b"ve", b"ll")


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = np.array([ord(c) for c in chars])
    joined = "".join(chars)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, joined):
            table[points[m.start() : m.end()]] = kind
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    table = _classes()
    out = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead):
        return out
    b = buf.astype(np.int32)
    for first, length, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        at = lead[(buf[lead] >= first) & (buf[lead] < first + (0x20 if length == 2 else 0x10))]
        if not len(at):
            continue
        point = b[at] & mask
        for k in range(1, length):
            point = (point << 6) | (b[at + k] & 0x3F)
        kind = table[point]
        for k in range(length):
            out[at + k] = kind
    return out


def pattern_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces, and each row's range of pieces; the pieces cover all bytes."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    kind = byte_classes(buf)
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    cut = row_start.copy()
    cut[1:-1] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut)  # the starts of runs of one class, and the end
    first, last = run[:-1], run[1:]
    spaces = kind[first] == SPACE
    follows = ~row_start[last]  # a run of another class follows in the same row
    # The last white space character before another run stands apart; a blank joins that run.
    gap = np.flatnonzero(spaces & follows)
    end = last[gap]
    tail = end - 1
    while True:  # step back over the other bytes of a longer character
        inner = (buf[tail] & 0xC0) == 0x80
        if not inner.any():
            break
        tail = tail - inner
    cut[tail] = True
    blank = buf[end - 1] == 0x20
    cut[end[blank]] = False
    # An apostrophe that stands alone before letters takes an ending with it.
    ticks = np.flatnonzero((last - first == 1) & (buf[first] == 0x27) & follows)
    ticks = ticks[kind[last[ticks]] == LETTER] if len(ticks) else ticks
    ticks = ticks[cut[first[ticks]]] if len(ticks) else ticks
    for t in ticks:
        at, stop = int(first[t]), int(last[t + 1])
        ending = buf[at + 1 : min(at + 3, stop)].tobytes()
        size = 1 if ending[:1] and ending[0] in SHORT_ENDINGS else 2 if ending in LONG_ENDINGS else 0
        if size:
            cut[at + 1] = False
            cut[at + 1 + size] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


class PieceCodes:
    """Numbers pieces in the order in which a task meets them; equal bytes get one number.

    Pieces are told apart by their 64-bit names.
    """

    def __init__(self):
        self.names = np.zeros(0, dtype=np.uint64)
        self.codes = np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def add(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each piece, and where the new pieces stand first, in the order of their codes."""
        found, place, inverse = np.unique(names, return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, found)
        known = np.zeros(len(found), dtype=bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == found[inside]
        code = np.empty(len(found), dtype=np.int64)
        code[known] = self.codes[at[known]]
        fresh = np.flatnonzero(~known)
        code[fresh] = len(self.names) + np.arange(len(fresh))
        self.names = np.insert(self.names, at[fresh], found[fresh])
        self.codes = np.insert(self.codes, at[fresh], code[fresh])
        return code[inverse], place[fresh]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many stretches, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
