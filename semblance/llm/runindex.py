"""A run-length index over a collection of byte strings, and matching statistics from it.

The suffixes are sorted by doubling; each string ends in a terminator of its own. Of the
Burrows-Wheeler transform only the run ends are used: at the head (or tail) of a run, the
longest common extension with the row before (or after) is computed; inside a run a position
inherits the value of the position before it, less one. So the statistics stream through the text from
the samples at run ends, of which a repetitive collection has few.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sort key, 9 bits each; bits that a place takes when it rides along in a key.
PACK, PLACE_BITS = 4, 21


class RunIndex:
    """Index of strings: suffix order, run-compressed transform, sampled run ends."""

    def __init__(self, strings: list[bytes]):
        lens = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(lens + 1) - 1  # places of the terminators
        self.starts = self.ends - lens
        n = int(self.ends[-1]) + 1
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[self.ends] = 0
        self.symbols = symbols
        self.text_of = np.repeat(np.arange(len(strings)), lens + 1)
        self.end_at = self.ends[self.text_of]
        self._sort(n, int(lens.max()) + 1)
        self._runs(n)

    def _sort(self, n: int, depth: int) -> None:
        """Ranks by the first PACK symbols, then doubled until every suffix differs."""
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        padded = np.concatenate([self.symbols, np.zeros(PACK, np.int64)])
        for k in range(PACK):
            key = (key << 9) | np.where(alive, padded[k : k + n], 0)
            alive &= padded[k : k + n] > 0
        self.levels, width, count = [], PACK, len(self.ends)
        # keys and their places fit in one word for all but very large collections, and are sorted as plain numbers
        packed, place = n + count < 1 << PLACE_BITS, np.arange(n)
        while True:
            if packed:
                ordered = np.sort((key << PLACE_BITS) | place)
                order, in_order = ordered & ((1 << PLACE_BITS) - 1), ordered >> PLACE_BITS
            else:
                order = np.argsort(key)
                in_order = key[order]
            fresh = np.empty(n, bool)
            fresh[:1], fresh[1:] = True, in_order[1:] != in_order[:-1]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
            self.levels.append((width, rank))
            if width >= depth or fresh.all():
                self.order, self.rank = order, rank
                return
            # past its terminator a suffix goes on with the number of its string, below all ranks
            at = place + width
            second = self.text_of.copy()
            inside = np.flatnonzero(at <= self.end_at)
            second[inside] = rank[inside + width].astype(np.int64) + count
            key = (rank.astype(np.int64) << (PLACE_BITS if packed else 32)) | second
            width *= 2

    def _runs(self, n: int) -> None:
        before = self.order - 1
        first = before < self.starts[self.text_of[self.order]]
        # the symbol before the first of a string is a terminator of its own
        self.transform = np.where(first, -1 - self.text_of[self.order], self.symbols[before])
        self.heads = np.flatnonzero(np.concatenate([[True], self.transform[1:] != self.transform[:-1]]))
        self.tails = np.append(self.heads[1:] - 1, n - 1)

    @property
    def runs(self) -> int:
        return len(self.heads)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j."""
        limit = np.minimum(self.end_at[i] - i, self.end_at[j] - j)
        got, n = np.zeros(len(i), np.int64), len(self.symbols)
        for width, rank in reversed(self.levels):
            at, to = np.minimum(i + got, n - 1), np.minimum(j + got, n - 1)
            got += np.where((rank[at] == rank[to]) & (got < limit), width, 0)
        for _ in range(PACK - 1):
            at, to = np.minimum(i + got, n - 1), np.minimum(j + got, n - 1)
            got += (self.symbols[at] == self.symbols[to]) & (got < limit)
        return np.minimum(got, limit)

    def statistics(self, least: int = 0) -> np.ndarray:
        """For each place the longest string from there that also starts elsewhere in the collection.

        With ``least``, values below it may come out smaller: run ends that agree on less are not extended.
        """
        width, rough = max(((w, r) for w, r in self.levels if w <= least), key=lambda x: x[0], default=(0, None))
        n, best = len(self.symbols), np.zeros(len(self.symbols), np.int64)
        place = np.arange(n)
        for rows, other in ((self.heads[self.heads > 0], -1), (self.tails[self.tails < n - 1], 1)):
            sampled = np.zeros(n, np.int64)
            at, to = self.order[rows], self.order[rows + other]
            if rough is not None:
                near = rough[at] == rough[to]
                at, to = at[near], to[near]
            sampled[at] = self.extension(at, to) + at
            best = np.maximum(best, np.maximum.accumulate(sampled) - place)
        return np.minimum(best, self.end_at - place)


def repeated(strings: list[bytes], length: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For each string the offsets from which ``length`` bytes also start elsewhere in the strings.

    A string that stands for several equal ones (``times``) is indexed once; its copies match it to its end.
    """
    index = RunIndex(strings)
    best = index.statistics(length)
    if times is not None:
        copied = np.repeat(np.asarray(times) > 1, index.ends - index.starts + 1)
        best = np.where(copied, index.end_at - np.arange(len(best)), best)
    long = best >= length
    return [np.flatnonzero(long[s:e]) for s, e in zip(index.starts, index.ends, strict=True)]
