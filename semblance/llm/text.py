"""Words and shingles of a text as 64-bit hashes, computed on whole byte arrays."""

from __future__ import annotations

import numpy as np

#: Bytes worked on at once; longer texts are cut at white space.
BLOCK = 1 << 22
_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Separators: ASCII white space; or all ASCII but letters and digits.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the power 0, 1, ... n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 2 * len(_powers)), BASE, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers[:n]


def _block_hashes(a: np.ndarray, separators: np.ndarray) -> np.ndarray:
    inside = ~separators[a]
    before = np.empty_like(inside)
    before[:1], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & before)
    if not len(starts):
        return np.empty(0, np.uint64)
    b = a[inside]
    first = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
    lens = np.diff(np.append(first, len(b)))
    place = np.arange(len(b)) - np.repeat(first, lens)
    return mix64(np.add.reduceat(BYTE_KEYS[b] * powers(int(lens.max()))[place], first) + lens.astype(np.uint64))


def word_hashes(text: str | None, separators: np.ndarray = BLANK) -> np.ndarray:
    """A hash for each word in turn, A-Z taken as a-z."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= BLOCK:
        return _block_hashes(np.frombuffer(data, np.uint8), separators)
    out, at = [], 0
    while at < len(data):
        a = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        end = at + len(a)
        if end < len(data):
            cuts = np.flatnonzero(separators[a])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:  # a word longer than a block
                rest = np.flatnonzero(separators[np.frombuffer(data, np.uint8, -1, end)])
                end = end + int(rest[0]) if len(rest) else len(data)
        out.append(_block_hashes(np.frombuffer(data, np.uint8, end - at, at), separators))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; fewer words: of the whole sequence; no words: empty."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(n, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s = s * BASE + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(s + np.uint64(n)))
