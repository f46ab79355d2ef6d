"""Feature hashes: 62-bit non-negative integers in Python, 60-bit ones in SQL."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK62, MASK64 = (1 << 62) - 1, (1 << 64) - 1
# The public constants of FNV-1a (64 bits) and of the splitmix64 finaliser.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
GOLDEN, POSITION = 0x9E3779B97F4A7C15, 0x165667B19E3779F9


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & MASK64
    return h & MASK62


def mix64(x: int) -> int:
    x &= MASK64
    x = ((x ^ (x >> 30)) * MIX_1) & MASK64
    x = ((x ^ (x >> 27)) * MIX_2) & MASK64
    return x ^ (x >> 31)


def mix(a: int, b: int) -> int:
    """Depends on the order of a and b."""
    x = (a * GOLDEN + b) & MASK64  # mix64, written out
    x = ((x ^ (x >> 30)) * MIX_1) & MASK64
    x = ((x ^ (x >> 27)) * MIX_2) & MASK64
    return (x ^ (x >> 31)) & MASK62


def mix_pos(h: int, pos: int) -> int:
    """h as an operand at a position."""
    x = (h + (pos + 1) * POSITION) & MASK64
    x = ((x ^ (x >> 30)) * MIX_1) & MASK64
    x = ((x ^ (x >> 27)) * MIX_2) & MASK64
    return (x ^ (x >> 31)) & MASK62


#: Hashes that are remembered, and the longest string among their parts.
REMEMBERED, SHORT = 1 << 14, 64


def feed(*parts) -> int:
    """One hash of a domain byte and a run of integers and strings; strings carry their length, so parts can't run together."""
    for p in parts:
        if type(p) is str and len(p) > SHORT:
            return _feed(*parts)
    return _fed(*parts)


def _feed(*parts) -> int:
    out = bytearray()
    for p in parts:
        if isinstance(p, str):
            raw = p.encode("utf-8", "surrogatepass")
            out += b"s" + len(raw).to_bytes(8, "little") + raw
        else:
            out += b"i" + (int(p) & MASK64).to_bytes(8, "little")
    return mix64(fnv1a(bytes(out))) & MASK62


_fed = lru_cache(REMEMBERED)(_feed)


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 digest: the same number in other SQL engines."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


# MD5 (RFC 1321).
MD5_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_STEP = 8192
#: By size of a message: which bytes of its block are its own, and what stands in the others.
_OWN, _PAD = np.zeros((56, 64), np.uint8), np.zeros((56, 64), np.uint8)
for _n in range(56):
    _OWN[_n, :_n], _PAD[_n, _n], _PAD[_n, 56], _PAD[_n, 57] = 255, 0x80, _n * 8 & 255, _n * 8 >> 8


def _md5_top(x: np.ndarray) -> np.ndarray:
    """The first 64 bits of the digests, of blocks as 16 rows of little-endian words."""
    state = [np.full(x.shape[1], v, np.uint32) for v in MD5_START]
    a, b, c, d = state
    f, t = np.empty_like(a), np.empty_like(a)
    for r in range(64):
        if r < 16:
            g = r
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif r < 32:
            g = (5 * r + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif r < 48:
            g = (3 * r + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * r % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        a += f
        a += x[g]
        a += np.uint32(MD5_K[r])
        turn = MD5_TURN[r // 16][r % 4]
        np.right_shift(a, np.uint32(32 - turn), out=t)
        np.left_shift(a, np.uint32(turn), out=a)
        np.bitwise_or(a, t, out=a)
        a += b
        a, b, c, d = d, a, b, c
    a, b = a + np.uint32(MD5_START[0]), b + np.uint32(MD5_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


def hash60_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """hash60 of the slices of a buffer of bytes, as int64; those of one MD5 block (55 bytes) many at a time."""
    out = np.empty(len(start), np.int64)
    size = end - start
    for i in np.flatnonzero(size > 55):
        out[i] = int.from_bytes(hashlib.md5(data[start[i] : end[i]].tobytes(), usedforsecurity=False).digest()[:8], "big") >> 4
    short = np.flatnonzero(size <= 55)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(64, np.uint8)]), 64)
    for k in range(0, len(short), MD5_STEP):
        i = short[k : k + MD5_STEP]
        block = windows[start[i]]
        block &= _OWN[size[i]]
        block |= _PAD[size[i]]
        out[i] = (_md5_top(np.ascontiguousarray(block.view("<u4").T)) >> np.uint64(4)).astype(np.int64)
    return out
