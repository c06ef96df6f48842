"""Token counts of a character BPE vocabulary, by merging many words at once.

The words of a task that it has not met yet are one ragged array of symbols. In each round every word
merges its lowest-ranked pair, all words at the same time; words without a mergeable pair leave the
array. The symbols that survive are the tokens; characters outside of the vocabulary count their
bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import pretoken as P
from spanloom.llm import text as T

LIMIT = 4096
#: The vocabulary's sign for a blank.
BLANK = "▁"
#: Distinct words after which a task forgets the counts it has.
LIST_WORDS = 2_000_000
_NEVER = np.iinfo(np.int64).max


def read_pieces(path: str) -> list[tuple[str, float] | None]:
    """Pieces and their scores by id from a vocabulary file; None for ids that merging can't produce."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [None if special(i) else (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    if any(BLANK in p[0].lstrip(BLANK) for p in pieces if p):
        raise ValueError("pieces must not hold a blank after another character")
    return pieces


class Merger:
    """Counts tokens of words, many at a time."""

    def __init__(self, pieces: list[tuple[str, float] | None]):
        ids = {p[0]: i for i, p in enumerate(pieces) if p is not None}
        scores = sorted({p[1] for p in pieces if p is not None}, reverse=True)
        rank = {score: i for i, score in enumerate(scores)}
        known = list(ids.items())
        #: Bytes that a symbol counts as: 1 for a piece, all its bytes for a lone character.
        weight = [1] * len(pieces)
        for p, _ in known:
            for c in p:
                if c not in ids:
                    ids[c] = len(weight)
                    weight.append(len(c.encode()))
        pairs = [
            (ids[p[:k]] << 32 | ids[p[k:]], i, rank[pieces[i][1]])
            for p, i in known
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        ]
        pairs.sort()
        self.keys, self.made, self.ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 3
        #: Ranks that several pieces share; of those the leftmost pair merges alone.
        shared = np.bincount([rank[p[1]] for p in pieces if p is not None], minlength=1) > 1
        self.shared = np.append(shared, False)
        # Characters of no piece follow the known symbols, one for each length in UTF-8.
        self.unknown = len(weight)
        self.weight = np.array(weight + [0, 1, 2, 3, 4], dtype=np.int64)
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for c, i in ids.items():
            if len(c) == 1:
                self.chars[ord(c)] = i

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, ``_NEVER`` if it doesn't merge, and the symbol it makes."""
        if not len(self.keys):
            return np.full(len(left), _NEVER), np.zeros(len(left), dtype=np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.made[at]

    def count(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word; ``points`` are the code points of all words, one after the other."""
        out = np.zeros(len(lengths), dtype=np.int64)
        symbol = self.chars[points].astype(np.int64)
        strange = symbol < 0
        c = points[strange]
        symbol[strange] = self.unknown + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank, made = np.full(len(symbol), _NEVER, dtype=np.int64), np.zeros(len(symbol), dtype=np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], made[same] = self._pair(symbol[same], symbol[same + 1])
        while len(symbol):
            head = np.ones(len(word), dtype=bool)
            head[1:] = word[1:] != word[:-1]
            heads = np.flatnonzero(head)
            size = np.diff(np.append(heads, len(word)))
            least = np.minimum.reduceat(rank, heads)
            over = least == _NEVER
            if over.any():
                sums = np.add.reduceat(self.weight[symbol], heads)
                out[word[heads[over]]] = sums[over]
                stay = np.repeat(~over, size)
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                least, size = least[~over], size[~over]
                if not len(symbol):
                    break
            chosen = rank == np.repeat(least, size)
            # Of pairs that overlap, as in a run of one symbol, every other one is taken from the left.
            behind = np.flatnonzero(chosen[1:] & chosen[:-1]) + 1
            if len(behind):
                index = np.arange(len(chosen))
                begin = np.where(chosen & ~np.append(False, chosen[:-1]), index, 0)
                begin = np.maximum.accumulate(begin)
                chosen &= (index - begin) % 2 == 0
            tied = self.shared[least]
            if tied.any():
                at = np.flatnonzero(chosen & np.repeat(tied, size))
                later = np.zeros(len(at), dtype=bool)
                later[1:] = word[at[1:]] == word[at[:-1]]
                chosen[at[later]] = False
            at = np.flatnonzero(chosen)
            symbol[at] = made[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            at = place[at]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[again] = _NEVER
            inner = again[again + 1 < len(word)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner], made[inner] = self._pair(symbol[inner], symbol[inner + 1])
        return out


def _blank_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the blanks before them: a word starts at a blank that no blank precedes."""
    start = np.zeros(len(buf) + 1, dtype=bool)
    blank = buf == 0x20
    start[1:-1] = blank[1:] & ~blank[:-1]
    start[offsets] = True
    starts = np.flatnonzero(start[:-1])
    return starts, np.append(starts[1:], len(buf)).astype(np.int64), np.searchsorted(starts, offsets)


def count_tokens(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row, as the vocabulary's own library counts them.

    The vocabulary marks blanks with U+2581, puts one before the text, leaves characters as they are
    and falls back to bytes. Null and empty texts have no tokens. Rows are handled one by one: repeated
    rows give repeated results, a null id stays null; other columns play no part.
    ``vocabulary_path`` is read on the driver only.
    """
    pieces = documents.sparkSession.sparkContext.broadcast(read_pieces(vocabulary_path))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        merger = Merger(pieces.value)
        seen, counts = P.PieceCodes(), np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            size = pc.binary_length(texts)
            plain = texts
            if pc.any(pc.match_substring(texts, BLANK)).as_py():
                plain = pc.replace_substring(texts, BLANK, " ")
            # a text that isn't empty gets the blank before it
            led = pc.if_else(pc.greater(size, 0), pc.binary_join_element_wise(" ", plain, ""), "")
            data, offsets = T.text_bytes(led)
            for a, z in T.chunks(offsets):
                buf, cut = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                starts, ends, rows = _blank_spans(buf, cut)
                if len(seen) > LIST_WORDS:
                    seen, counts = P.PieceCodes(), np.zeros(0, dtype=np.int64)
                codes, first = seen.add(T.span_names(buf, starts, ends))
                if len(first):
                    sizes = (ends - starts)[first]
                    words = buf[P.ragged(starts[first], sizes)]
                    points = np.frombuffer(words.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
                    points[points == 0x20] = ord(BLANK)
                    heads = (words & 0xC0) != 0x80
                    lengths = np.add.reduceat(heads.astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
                    counts = np.append(counts, merger.count(points, lengths))
                total = np.append(0, np.cumsum(counts[codes]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, z - a),
                        size.slice(a, z - a).cast(pa.int64()),
                        pa.array(np.diff(total[rows])),
                    ],
                    ["id", "n_bytes", "n_tokens"],
                )

    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")


def count_report(documents: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more tokens than ``limit``."""
    return count_tokens(documents, vocabulary_path).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
