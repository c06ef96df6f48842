"""Plain versions of source mixing, periodic runs and collocations."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from fractions import Fraction

from llm_brute import LOWER, sha, space_words


def targets(sizes: dict, weights=(5, 2, 1), share=150, most=2):
    """Target of each source: the excess of those that stop is shared anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = Fraction(share * sum(sizes.values()), 100), set(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / whole >= most * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def runs(words, least=12):
    """``(start, period, length)`` of all runs, from every period's stretches."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
    return sorted((s, q, length) for (s, length), q in out.items())


def kept_words(words, found):
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def run_report(doc_id, text):
    w = space_words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
    top = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    best = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (len(found), *best, sha(lines), sha(" ".join(kept_words(w, found))))


def collocations(rows, depth=3, least=10, top=2000, inside=50):
    counts, n = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {
            p[i:j] for p, a in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * a >= inside * some[p[i:j]]
        }
        scored = []
        for p, a in some.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)
