"""Units in blocks, and pairs of blocks as tiles: whatever two units share is found where both their blocks are, so neither pairs nor features are shuffled for it.

Each unit stands in one block, a row with its arrays; a tile reads two blocks from the shared folder. Equal units of a block are one until their pairs are
known, then every pair is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rarest features of a unit that propose candidates however frequent they are.
RAREST = 8
#: Meetings that are looked at, and pairs that are returned, at a time.
STEP = 1 << 17
PAIRS = 1 << 18
#: Cells of a tile that are marked at a time.
CELLS = 1 << 24
SLACK = 1e-6
#: Blocks that those of a task meet.
TOGETHER = 4
#: Features of a unit and of all it is compared with, up to which sorting them takes less than a step for the unit.
LITTLE = 400
ARRAYS = {"ids": np.int64, "n_feat": np.int64, "wsum": np.int64, "alone": np.int64, "low": np.int64, "start": np.int64, "h": np.int64, "w": None, "at": np.int32, "first": np.int64, "member": np.int64}
BLOCK = "block int, kind string, " + ", ".join(f"{k} binary" for k in ARRAYS)
SCORED = "a bigint, b bigint, n_a int, n_b int, sa bigint, sb bigint, shared bigint"
LINKED = "a bigint, b bigint"


class Block:
    """The arrays of a block: of its units (ids, n_feat, wsum, alone, low, start), of their features (h, w, the rarest first), of those that meet others by hash (at), and the equal ones of each unit (first, member)."""

    def __init__(self, data: dict):
        for k, kind in ARRAYS.items():
            setattr(self, k, np.frombuffer(data[k], kind or np.dtype(data["kind"])))
        self.n = len(self.ids)
        size = np.diff(self.start)
        self.unit = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.all_probe = np.array_equal(self.low, size)

    @cached_property
    def probe(self) -> np.ndarray:
        """Whether a feature is one up to the cutoff, or of the unit's rarest."""
        size = np.diff(self.start)
        place = np.arange(len(self.h), dtype=np.int32) - np.repeat(self.start[:-1].astype(np.int32), size)
        return place < np.repeat(np.maximum(self.low, RAREST - (self.n_feat - size)).astype(np.int32), size)

    @cached_property
    def meets(self) -> np.ndarray:
        """The hashes that meet others, ascending."""
        return self.h[self.at]

    @cached_property
    def rests(self) -> np.ndarray:
        """Of the features that meet others, the weight of their unit from there on."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.w, dtype=np.int64)])
        unit = self.unit[self.at]
        return (self.wsum - self.alone)[unit] - (total[self.at] - total[self.start[unit]])


def block_of(block: int, ids, n_feat, wsum, alone, same, start, h, w, df, cutoff: int, prefix: float | None) -> pa.Table:
    """One row. With ``prefix`` only features with at most that share of their unit's weight before them meet others."""
    seen: dict[bytes, int] = {}
    rep = np.fromiter((i if s is None else seen.setdefault(s, i) for i, s in enumerate(same)), np.int64, len(ids))
    own = rep == np.arange(len(ids))
    order = np.argsort(rep, kind="stable")
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(rep, minlength=len(ids))[own])])
    size = np.diff(start)
    kept = np.repeat(own, size)
    h, w, df, size = h[kept], w[kept], df[kept], size[own]
    unit, start = np.repeat(np.arange(len(size)), size), np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    low = np.bincount(unit[df <= cutoff], minlength=len(size))
    at = np.argsort(h, kind="stable")
    if prefix is not None:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(w, dtype=np.int64)])
        before = total[:-1] - total[start[unit]] + alone[own][unit]
        at = at[(before <= prefix * wsum[own][unit] + SLACK)[at]]
    w = w.astype(np.uint8) if not len(w) or 0 <= w.min() and w.max() < 256 else w.astype(np.int32)
    data = {"ids": ids[own], "n_feat": n_feat[own], "wsum": wsum[own], "alone": alone[own], "low": low, "start": start, "h": h, "w": w, "at": at, "first": first, "member": ids[order]}
    cols = {"block": pa.array([block], pa.int32()), "kind": pa.array([w.dtype.str])}
    return pa.table(cols | {k: pa.array([np.ascontiguousarray(v, ARRAYS[k] or v.dtype).tobytes()], pa.binary()) for k, v in data.items()})


def runs(lo: np.ndarray, n: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place): each row with the n places from lo on, about ``step`` of them at a time; rows of many are cut."""
    x = np.flatnonzero(n > 0)
    lo, n = lo[x], n[x]
    ends = np.cumsum(n, dtype=np.int64)
    done, all_ = 0, int(ends[-1]) if len(x) else 0
    while done < all_:
        upto = min(done + step, all_)
        i, j = np.searchsorted(ends, done, "right"), np.searchsorted(ends, upto, "left") + 1
        head = ends[i:j] - n[i:j]
        cut = np.maximum(head, done)
        k = np.minimum(ends[i:j], upto) - cut
        row = np.repeat(x[i:j], k)
        yield row, np.arange(done, upto) + np.repeat(lo[i:j] - head, k)
        done = upto


def _members(x: Block, y: Block, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, id, id): the pairs of units a of x and b of y with all their equal ones."""
    if len(x.member) == x.n and len(y.member) == y.n:
        for k in range(0, len(a), PAIRS):
            yield np.arange(k, min(k + PAIRS, len(a))), x.ids[a[k : k + PAIRS]], y.ids[b[k : k + PAIRS]]
        return
    for pair, m in runs(x.first[a], x.first[a + 1] - x.first[a], PAIRS):
        of = b[pair]
        for r, k in runs(y.first[of], y.first[of + 1] - y.first[of], PAIRS):
            yield pair[r], x.member[m[r]], y.member[k]


def _equal(x: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, id, id): the pairs of equal units of a block."""
    unit = np.repeat(np.arange(x.n), np.diff(x.first))
    at = np.arange(len(unit))
    for r, k in runs(at + 1, x.first[unit + 1] - at - 1, PAIRS):
        yield unit[r], x.member[r], x.member[k]


def _found(x: Block, y: Block, own: bool, threshold: float, metric: str) -> np.ndarray:
    """The distinct pairs, as unit of x times units of y plus unit of y, that may reach the threshold by the place of the rarest feature they share.

    The lighter unit of such a pair has the threshold's share of its weight in common, so that feature stands in its prefix; for 'jaccard' in that of both.
    """
    hx, hy = x.meets, y.meets
    lo = np.arange(1, len(hx) + 1) if own else np.searchsorted(hy, hx, "left")
    met = np.flatnonzero(lo < len(hy))
    met = met[hy[lo[met]] == hx[met]]
    lo = lo[met]
    end = np.searchsorted(hy, hx[met], "right")
    rx, ry = x.rests, y.rests
    out = [np.empty(0, np.int64)]
    for r, k in runs(lo, end - lo, STEP):
        r = met[r]
        p, q = x.at[r], y.at[k]
        u, v = x.unit[p].astype(np.int64), y.unit[q].astype(np.int64)
        wu, wv, ru, rv = x.wsum[u], y.wsum[v], rx[r], ry[k]
        most = np.minimum(ru, rv)
        if metric == "jaccard":
            ok = most + SLACK >= threshold * (wu + wv - most)
        else:
            lighter = (wu < wv) | (wu == wv) & (x.ids[u] < y.ids[v])
            light, before = np.minimum(wu, wv), np.where(lighter, wu - ru, wv - rv)
            ok = (most + SLACK >= threshold * light) & (before <= (1 - threshold) * light + SLACK)
        # a frequent feature proposes nothing unless it is one of the rarest of either
        if not (x.all_probe or y.all_probe):
            ok &= x.probe[p] | y.probe[q]
        u, v = u[ok], v[ok]
        out.append(np.unique(np.minimum(u, v) * y.n + np.maximum(u, v) if own else u * y.n + v))
    return np.unique(np.concatenate(out))


def _sums_by_sort(x: Block, y: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of minima of units a of x and b of y: the features of both by pair and hash, so that common ones stand together."""
    out = np.zeros(len(a), np.int64)
    sides = []
    for of, u in ((x, a), (y, b)):
        n = of.start[u + 1] - of.start[u]
        pair = np.repeat(np.arange(len(u)), n)
        at = np.arange(len(pair)) + np.repeat(of.start[u] - (np.cumsum(n) - n), n)
        sides.append((pair, of.h[at], of.w[at].astype(np.int64)))
    pair, h, w = map(np.concatenate, zip(*sides))
    order = np.lexsort((h, pair))
    pair, h, w = pair[order], h[order], w[order]
    met = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    np.add.at(out, pair[met], np.minimum(w[met], w[met + 1]))
    return out


def _sums(x: Block, y: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of minima of units a (ascending) of x and b of y."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    cuts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    size = x.start[a + 1] - x.start[a] + y.start[b + 1] - y.start[b]
    held = np.add.reduceat(size, cuts[:-1])
    # units with little to compare, many at a time
    few = np.flatnonzero(np.repeat(held <= LITTLE, np.diff(cuts)))
    ends = np.cumsum(size[few])
    for lo in range(0, int(ends[-1]) if len(few) else 0, STEP):
        k = few[slice(*np.searchsorted(ends, [lo, lo + STEP], "right"))]
        out[k] = _sums_by_sort(x, y, a[k], b[k])
    many = np.flatnonzero(held > LITTLE)
    for i, j in zip(cuts[many], cuts[many + 1]):
        own = slice(x.start[a[i]], x.start[a[i] + 1])
        order = np.argsort(x.h[own])
        h, w = x.h[own][order], x.w[own][order]
        lo = y.start[b[i:j]]
        size = y.start[b[i:j] + 1] - lo
        head = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - head, size)
        g = y.h[at]
        k = np.minimum(np.searchsorted(h, g), len(h) - 1)
        out[i:j] = np.add.reduceat(np.where(h[k] == g, np.minimum(w[k], y.w[at]), 0), head, dtype=np.int64)
    return out


def scored_tile(threshold: float, metric: str) -> Callable:
    """Rows of SCORED: the pairs that reach the threshold (up to rounding, so what reads them compares again)."""

    def tile(x: Block, y: Block, own: bool) -> Iterator[pa.RecordBatch]:
        found = _found(x, y, own, threshold, metric)
        a, b = found // max(y.n, 1), found % max(y.n, 1)
        s = _sums(x, y, a, b)
        wa, wb = x.wsum[a], y.wsum[b]
        ok = s >= threshold * (wa + wb - s) - SLACK if metric == "jaccard" else s >= threshold * np.minimum(wa, wb) - SLACK
        a, b, s = a[ok], b[ok], s[ok]

        def rows(m, n, f, g, shared) -> pa.RecordBatch:
            back = m > n
            cols = [np.minimum(m, n), np.maximum(m, n), *[np.where(back, w, v) for v, w in ((x.n_feat[f], y.n_feat[g]), (y.n_feat[g], x.n_feat[f]), (x.wsum[f], y.wsum[g]), (y.wsum[g], x.wsum[f]))], shared]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k in (2, 3) else c) for k, c in enumerate(cols)], ["a", "b", "n_a", "n_b", "sa", "sb", "shared"])

        for k, m, n in _members(x, y, a, b):
            yield rows(m, n, a[k], b[k], s[k])
        if own and threshold <= 1:
            for u, m, n in _equal(x):
                yield rows(m, n, u, u, x.wsum[u])

    return tile


def linked_tile(x: Block, y: Block, own: bool) -> Iterator[pa.RecordBatch]:
    """Rows of LINKED: the pairs that share a feature by which one proposes the other, marked in a table of units of x by units of y."""
    px, py = x.probe[x.at], y.probe[y.at]
    # what proposes meets all, what doesn't meets what does; the units of y for both one behind the other
    sides = [(x.at[px], y.at, 0), (x.at[~px], y.at[py], len(y.at))]
    into = np.concatenate([y.unit[q] for _, q, _ in sides])
    entries = []
    for p, q, off in sides:
        h, g = x.h[p], y.h[q]
        lo = np.searchsorted(g, h, "left").astype(np.int32)
        n = np.searchsorted(g, h, "right").astype(np.int32) - lo
        some = n > 0
        entries.append((x.unit[p[some]], lo[some] + np.int32(off), n[some]))
    unit, lo, n = map(np.concatenate, zip(*entries))
    del entries, h, g, some
    order = np.argsort(unit, kind="stable")
    unit, lo, n = unit[order], lo[order], n[order]
    step = max(1, CELLS // max(1, y.n))
    for u in range(0, x.n, step):
        part = slice(*np.searchsorted(unit, [u, u + step]))
        marks = np.zeros(min(step, x.n - u) * y.n, bool)
        for r, k in runs(lo[part], n[part], STEP):
            marks[(unit[part][r] - u).astype(np.int64) * y.n + into[k]] = True
        met = np.flatnonzero(marks)
        a, b = met // max(y.n, 1) + u, met % max(y.n, 1)
        if own:
            a, b = a[a < b], b[a < b]
        for _, m, k in _members(x, y, a, b):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(m, k)), pa.array(np.maximum(m, k))], ["a", "b"])
    if own:
        for _, m, k in _equal(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(m, k)), pa.array(np.maximum(m, k))], ["a", "b"])


def over_tiles(blocks: DataFrame, tile: Callable, schema: str, work=None) -> DataFrame:
    """What ``tile`` makes of each two blocks, and of each with itself. A block is sent to Python once, before all that a task has it meet.

    With a workspace the result is written: a task then has some blocks meet TOGETHER others, read once for all, and Python gets a row at a time.
    """
    names = blocks.columns
    arrays = [c for c in names if c in ARRAYS]
    x = blocks.select([F.col(c).alias(f"x_{c}") for c in names])
    y = blocks
    if work is not None:
        n, tasks = blocks.rdd.getNumPartitions(), 4 * blocks.sparkSession.sparkContext.defaultParallelism
        groups = -(-n // TOGETHER)
        x, y = x.coalesce(max(groups, min(n, -(-tasks // groups)))), blocks.coalesce(groups)
    # a row without arrays stands before the others of each partition, for those of x; rows are gone through in their order for each of x
    head = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    y = y.withColumn("head", head).withColumn("own", F.explode(F.when(F.col("head"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    y = y.select("own", "block", "kind", *[F.when(~F.col("own"), F.col(c)).alias(c) for c in arrays])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            for i, (m, own, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x_block", "own", "block")))):
                if own or m != n:
                    block = Block({c: batch.column(c)[i].as_buffer() if c in ARRAYS else batch.column(c)[i].as_py() for c in names})
                if own:
                    at, first = m, block
                elif m != at:
                    raise ValueError(f"block {m} does not come before those it meets")
                else:
                    yield from tile(first, first if m == n else block, m == n)
                block = None
            del batch  # before the next comes

    met = x.join(y.hint("shuffle_replicate_nl"), F.col("own") | (F.col("x_block") <= F.col("block")))
    sent = [F.when(F.col("own"), F.col(f"x_{c}")).when(F.col("x_block") < F.col("block"), F.col(c)).alias(c) for c in arrays]
    out = met.select("x_block", "own", "block", F.when(F.col("own"), F.col("x_kind")).otherwise(F.col("kind")).alias("kind"), *sent).mapInArrow(each, schema)
    # shuffled first, so that not each task creates files
    return out if work is None else work.keep(out.hint("rebalance"), rows=1)
