"""The array functions inside of the operators against plain ones, on generated texts."""

import numpy as np
import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import pretoken, recompression, substring_dedup, text, token_count

ODD = "aZéß1²½ \t\n\r\u00a0\u2003\u3000'\"!-_=日語🙂\u0301▁ sdtmrevl"
texts = st.lists(st.text(st.sampled_from(ODD), max_size=40) | st.text(max_size=20), min_size=1, max_size=6)


def joined(rows):
    parts = [t.encode() for t in rows]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)


@settings(max_examples=600, deadline=None)
@given(texts)
def test_pattern_spans(rows):
    rows = [t.encode("utf-8", "ignore").decode() for t in rows]
    buf, cut = joined(rows)
    starts, ends, ranges = pretoken.pattern_spans(buf, cut)
    got = [[buf[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(ranges, ranges[1:])]
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in rows]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_token_counts(rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    merger = _merger(path)
    for t in rows:
        t = t.encode("utf-8", "ignore").decode()
        buf, cut = joined([" " + t.replace("▁", " ") if t else ""])
        starts, ends, _ = token_count._blank_spans(buf, cut)
        words = [buf[s:e].tobytes().decode().replace(" ", "▁") for s, e in zip(starts, ends)]
        points = np.array([ord(c) for w in words for c in w], dtype=np.int64)
        assert merger.count(points, np.array([len(w) for w in words], dtype=np.int64)).sum() == len(library.encode(t))


_MERGERS = {}


def _merger(path):
    if path not in _MERGERS:
        _MERGERS[path] = token_count.Merger(token_count.read_pieces(path))
    return _MERGERS[path]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_word_spans_and_names(rows):
    rows = [t.encode("utf-8", "ignore").decode() for t in rows]
    buf, cut = joined(rows)
    starts, ends, ranges = text.word_spans(buf, cut, text.IS_SPACE)
    words = [buf[s:e].tobytes() for s, e in zip(starts, ends)]
    want = [[w for w in regex.split(rb"[\x20\x09-\x0D]+", t.encode()) if w] for t in rows]
    assert words == [w for row in want for w in row] and np.diff(ranges).tolist() == [len(w) for w in want]
    names = text.span_names(buf, starts, ends)
    assert len(set(names.tolist())) == len(set(words))
    assert dict(zip(words, names.tolist())) == {w: int(text.span_names(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=50, max_size=120), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equal_windows_share_borders(window, before, after):
    """Whatever stands around it, a stretch is parsed alike but for the margin."""
    name = lambda x: text.mix(np.array(x, dtype=np.uint64) + np.uint64(1))
    margin = recompression.margin()

    def borders(lead, tail):
        _, starts = recompression.parse(name([*lead, *window, *tail]), np.array([0]))
        inner = starts - len(lead)
        return [int(x) for x in inner if margin <= x <= len(window) - margin]

    alone = borders([], [])
    assert alone == borders(before, after)
    assert all(b - a <= recompression.longest_symbol() for a, b in zip(alone, alone[1:]))


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 3), min_size=50, max_size=110) | st.lists(st.integers(0, 40), min_size=50, max_size=110) | st.just([1] * 70),
    st.lists(st.integers(0, 3), max_size=30),
    st.lists(st.integers(0, 3), max_size=30),
)
def test_symbols_reveal_and_verify_equal_windows(words, before, after):
    """A window has one key and one pair of names, wherever it stands; different windows have different names."""

    def of(lead, tail):
        names = text.mix(np.array([*lead, *words, *tail], dtype=np.uint64) + np.uint64(1))
        rows = np.array([0, len(names)])
        keys = {}
        for key, _, _, first, n in zip(*substring_dedup.anchors(names, rows, 50)):
            keys |= {int(first) + i - len(lead): int(key) for i in range(n)}
        at = np.arange(len(words) - 49)[::-1]
        return [keys[i] for i in at], list(zip(*(x.tolist() for x in substring_dedup._window_names(names, rows, at + len(lead), 50))))

    alone = of([], [])
    assert alone == of(before, after)
    windows = [tuple(words[i : i + 50]) for i in range(len(words) - 49)][::-1]
    assert len(set(zip(windows, alone[1]))) == len(set(windows)) == len(set(alone[1]))
