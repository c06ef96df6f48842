"""Recompression of word sequences: rounds of run and pair naming, and what two equal stretches share.

A symbol's name follows from the words it covers alone, so all tasks name one sequence of words alike and
no round needs a shuffle. Of a stretch, the symbols at its ends may be joined with what stands outside;
:meth:`Symbols.uncross` takes those away round by round, by rules that look at the stretch only. What is left
at a level, and what was taken away on the way there, are the same wherever the stretch occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from spanloom.llm.text import U64, BlockNames, mix

#: Most words of a run symbol and of a pair symbol in each of the first rounds.
ROUNDS = ((2, 4), (4, 8))
#: All rounds; symbols of the later ones have any length.
ALL_ROUNDS = (*ROUNDS, (None, None), (None, None))
_LEFT, _RIGHT, _TOP = U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)


def margin(rounds=ROUNDS) -> int:
    """Words at either end of a window whose parse can depend on what stands outside of it.

    A round's run step can change the run at the window's border (as long as its own limit), its
    pair step one more symbol (as long as symbols are before the step).
    """
    lost, longest = 0, 1
    for run, pair in rounds:
        longest = max(longest, run)
        lost += run + longest
        longest = max(longest, pair)
    return lost


def longest_symbol(rounds=ROUNDS) -> int:
    return max(max(pair, run) for run, pair in rounds)


class _Runs:
    """Names maximal runs of one symbol that hold at most ``most`` words."""

    def __init__(self, names, starts, ends, first, most, level):
        n = len(names)
        head = np.ones(n, dtype=bool)
        head[1:] = (names[1:] != names[:-1]) | first[1:]
        heads = np.flatnonzero(head)
        count = np.diff(np.append(heads, n))
        named = count > 1
        if most is not None:
            named &= ends[heads + count - 1] - starts[heads] <= most
        self.keep = head | ~np.repeat(named, count)
        self.names, self.ends = names.copy(), ends.copy()
        at = heads[named]
        self.names[at] = mix(names[at] ^ (count[named].astype(U64) * U64(0xD6E8FEB86659FD93)))
        self.ends[at] = ends[at + count[named] - 1]
        self.run, self.heads = np.cumsum(head) - 1, np.append(heads, n)

    def inner(self, low, high):
        """Symbols ``low`` to ``high`` without the runs at either end, which may go on outside."""
        return self.heads[self.run[low] + 1], self.heads[self.run[high - 1]]


class _Pairs:
    """Names neighbours of which the left is of one half of all symbols and the right of the other."""

    def __init__(self, names, starts, ends, first, most, level):
        self.left = (mix(names + U64(level * 0x9E3779B97F4A7C15 % (1 << 64))) & U64(1)).astype(bool)
        joined = np.zeros(len(names), dtype=bool)
        joined[:-1] = self.left[:-1] & ~self.left[1:] & ~first[1:]
        if most is not None:
            joined[:-1] &= ends[1:] - starts[:-1] <= most
        at = np.flatnonzero(joined)
        self.names, self.ends = names.copy(), ends.copy()
        self.names[at] = mix(mix(names[at] + U64(0xA0761D6478BD642F)) ^ names[at + 1])
        self.ends[at] = ends[at + 1]
        self.keep = np.ones(len(names), dtype=bool)
        self.keep[at + 1] = False

    def inner(self, low, high):
        """Without a first symbol that one outside may take, and a last one that may take one outside."""
        return low + ~self.left[low], high - self.left[high - 1]


class Symbols:
    """All levels of the symbols of ``words``; ``row_starts`` holds the index of every row's first word.

    Level 0 are the words' names; each round adds a level of runs and one of pairs. ``names[k]`` and
    ``starts[k]`` hold a level's names and first word indices. Symbols do not cross rows.
    """

    def __init__(self, words: np.ndarray, row_starts: np.ndarray, rounds=ALL_ROUNDS):
        starts = np.arange(len(words))
        ends = starts + 1
        first = np.zeros(len(words), dtype=bool)
        first[row_starts[row_starts < len(words)]] = True
        self.names, self.starts, self._steps, self._places = [words], [starts], [], []
        self._blocks: dict[tuple[int, int], BlockNames] = {}
        for level, limits in enumerate(rounds):
            for naming, most in zip((_Runs, _Pairs), limits):
                step = naming(self.names[-1], starts, ends, first, most, level)
                starts, ends, first = starts[step.keep], step.ends[step.keep], first[step.keep]
                self.names.append(step.names[step.keep])
                self.starts.append(starts)
                self._places.append(np.append(0, np.cumsum(step.keep)))
                self._steps.append(step)
                del step.names, step.ends, step.keep

    def sequence(self, level: int, base: int) -> BlockNames:
        """Names of sequences of a level's symbols."""
        if (level, base) not in self._blocks:
            self._blocks[level, base] = BlockNames(self.names[level], base)
        return self._blocks[level, base]

    def uncross(
        self, starts: np.ndarray, ends: np.ndarray, least: int, bases: Sequence[int] = ()
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Level, first and end of the symbols that each stretch of words has in common with all its copies.

        Stretches are words ``starts`` to ``ends`` of one row, none empty. Each rises as far as ``least`` symbols are
        left. For each of ``bases`` there is a name of the whole stretch: of the symbols taken away, level by
        level, and of those left. Equal stretches have equal names; equal names of different ones take a
        collision of 64-bit names within otherwise equal symbols.
        """
        low, high = starts.copy(), ends.copy()
        level = np.zeros(len(low), dtype=np.int8)
        names = [np.zeros(len(low), dtype=U64) for _ in bases]
        live = np.arange(len(low))
        for k, (step, places) in enumerate(zip(self._steps, self._places)):
            a, b = step.inner(low[live], high[live])
            to_low, to_high = places[a], places[b]
            rises = to_high - to_low >= least
            live, a, b = live[rises], a[rises], b[rises]
            for base, name in zip(bases, names):
                blocks = self.sequence(k, base)
                taken = mix(name[live] + blocks.name(low[live], a) * _LEFT)
                name[live] = mix(taken + blocks.name(b, high[live]) * _RIGHT)
            low[live], high[live], level[live] = to_low[rises], to_high[rises], k + 1
            if not len(live):
                break
        for base, name in zip(bases, names):
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                left = self.sequence(int(k), base).name(low[at], high[at])
                name[at] = mix(name[at] + (left + U64(k)) * _TOP)
        return level, low, high, names


def parse(words: np.ndarray, row_starts: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and first word indices of the symbols that are left after all ``rounds``.

    Of two equal stretches, the parses of the first rounds agree but for ``margin()`` words at the ends.
    """
    symbols = Symbols(words, row_starts, rounds)
    return symbols.names[-1], symbols.starts[-1]
