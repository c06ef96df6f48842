"""Plain, single-process versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import string
import struct
import zlib

import public_tokenizers

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(docs, window=50):
    words = {i: space_words(t) for i, t in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontamination(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near_duplicates(docs, share=80):
    sets = {}
    for i, text in docs:
        w = space_words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= share * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def byte_bpe(docs, name="byte_bpe_multi_50k.tiktoken"):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, text in docs:
        ids = enc.encode_ordinary(text or "")
        out[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or ""))
    return out


def token_counts(docs, name="piece_bpe_32k.model", limit=4096):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out = {}
    for i, text in docs:
        n = len(sp.encode(text or ""))
        out[i] = (len((text or "").encode()), n, n > limit)
    return out


def token_output(docs, name="byte_bpe_50k.json", end_id=2):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    out, start = {}, 0
    for i, text in sorted(docs):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out
