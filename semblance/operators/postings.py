"""Features dealt out by hash, counted, and brought back to their units: packed columns instead of a row for each feature.

A feature that stands in one unit (most of them) is shared with none, so only its weight comes back. Numbers travel as planes of bytes, hashes as
steps between sorted ones, which the codec of a shuffle brings to about nine bytes for a feature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import TEXTS, shingles_of
from .tiles import BLOCK, block_of

#: Features that are dealt out at a time.
CHUNK = 1 << 18
#: Features of several units in a block, and how many make a second block worth while.
HELD = 800_000
FEW = 100_000
#: An odd factor and its inverse modulo 2 ** 64: spreads hashes of any range over the buckets, and back.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 1 << 64)
#: Stands for a null id, which meets no other but counts in the frequencies.
NO_ID = -(1 << 63)
DEALT = "bucket int, kind int, fid binary, h binary, w binary, df binary"
UNITS = "fid bigint, n_feat int, wsum bigint, alone bigint, same binary, h array<bigint>, w array<int>, df array<int>"


def planes(a: np.ndarray) -> bytes:
    """64-bit numbers by place of their bytes."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: list[bytes], kind=np.int64) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel() for x in data]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _steps(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def _unstepped(data: list[bytes], kind=np.int64) -> np.ndarray:
    return np.concatenate([np.cumsum(unplaned([x], kind), dtype=kind) for x in data]) if data else np.empty(0, kind)


def _bucket(a: np.ndarray, n: int) -> np.ndarray:
    return ((a.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(40)).astype(np.int64) % n


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "kind", "fid", "h", "w", "df"])


def _cuts(buckets: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, np.array([len(buckets)])])


def _dealt(fid: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of kind 0 with the features by hash, and of kind 1 with sizes and weights of the units by id."""
    rows, m = [], h.view(np.uint64) * np.uint64(SPREAD)
    order = np.argsort(m, kind="stable")
    m, f, v = m[order], fid[order], w[order]
    # by the top of the spread hash, so that buckets are runs
    buckets = (m >> np.uint64(40)).astype(np.int64) * n >> 24
    cuts = _cuts(buckets)
    rows += [(int(buckets[i]), 0, planes(f[i:j]), _steps(m[i:j]), planes(v[i:j]), None) for i, j in zip(cuts, cuts[1:])]
    ids, at = np.unique(fid, return_inverse=True)
    sizes, sums = np.bincount(at, minlength=len(ids)), np.zeros(len(ids), np.int64)
    np.add.at(sums, at, w)
    buckets = _bucket(ids, n)
    order = np.argsort(buckets, kind="stable")
    cuts = _cuts(buckets[order])
    rows += [(int(buckets[o[0]]), 1, planes(ids[o]), planes(sizes[o]), planes(sums[o]), None) for o in (order[i:j] for i, j in zip(cuts, cuts[1:]))]
    return _rows(rows)


def _counted(t: pa.Table, n: int) -> list[pa.RecordBatch]:
    """What came by hash with frequencies, for the buckets by id: kind 0 features of more than one unit, kind 1 sizes and weights, kind 2 those of rows that stood twice."""
    cols = {k: t.column(k).to_pylist() for k in ("bucket", "kind", "fid", "h", "w")}
    own = [i for i, k in enumerate(cols["kind"]) if k == 0]
    rows = [(cols["bucket"][i], 1, cols["fid"][i], cols["h"][i], cols["w"][i], None) for i, k in enumerate(cols["kind"]) if k == 1]
    if own:
        m = _unstepped([cols["h"][i] for i in own], np.uint64)
        fid, w = unplaned([cols["fid"][i] for i in own]), unplaned([cols["w"][i] for i in own])
        order = np.argsort(m, kind="stable")
        m = m[order]
        many = np.zeros(len(m), bool)
        many[1:] = m[1:] == m[:-1]
        many[:-1] |= many[1:]
        m, fid, w = m[many], fid[order[many]], w[order[many]]
        order = np.lexsort((w, fid, m))
        m, fid, w = m[order], fid[order], w[order]
        last = np.ones(len(m), bool)
        last[:-1] = (m[1:] != m[:-1]) | (fid[1:] != fid[:-1])
        if not last.all():
            gone, off = fid[~last], w[~last]
            buckets = _bucket(gone, n)
            rows += [(int(b), 1, planes(gone[x]), planes(np.full(x.sum(), -1)), planes(-off[x]), None) for b in np.unique(buckets) for x in (buckets == b,)]
            m, fid, w = m[last], fid[last], w[last]
        cuts = _cuts(m) if len(m) else np.zeros(1, np.int64)
        df = np.repeat(np.diff(cuts), np.diff(cuts))
        x = (df > 1) & (fid != NO_ID)
        fid, w, df, h = fid[x], w[x], df[x], (m[x] * np.uint64(UNSPREAD)).view(np.int64)
        buckets = _bucket(fid, n)
        order = np.lexsort((fid, buckets))
        cuts = _cuts(buckets[order]) if len(order) else np.zeros(1, np.int64)
        rows += [(int(buckets[o[0]]), 0, _steps(fid[o]), planes(h[o]), planes(w[o]), planes(df[o])) for o in (order[i:j] for i, j in zip(cuts, cuts[1:]))]
    return [_rows(rows[i : i + 64]) for i in range(0, len(rows), 64)]


def _unit_arrays(t: pa.Table) -> tuple:
    """ids, n_feat, wsum, alone, same, start, h, w, df of the units that features and sizes came for."""
    cols = {k: t.column(k).to_pylist() for k in ("kind", "fid", "h", "w", "df")}
    own, sums = ([i for i, k in enumerate(cols["kind"]) if k == x] for x in (0, 1))
    of = lambda c, at: [cols[c][i] for i in at]
    ids, at = np.unique(unplaned(of("fid", sums)), return_inverse=True)
    n_feat, wsum = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(n_feat, at, unplaned(of("h", sums)))
    np.add.at(wsum, at, unplaned(of("w", sums)))
    fid, h, w, df = _unstepped(of("fid", own)), unplaned(of("h", own)), unplaned(of("w", own)), unplaned(of("df", own))
    order = np.lexsort((h, df, fid))
    fid, h, w, df = fid[order], h[order], w[order], df[order]
    ends = np.searchsorted(fid, ids, side="right")
    starts = np.searchsorted(fid, ids, side="left")
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(w)])
    alone = wsum - (total[ends] - total[starts])
    count = ends - starts
    # units without a feature of their own may be equal to others
    same = [hashlib.sha256(h[i:j].tobytes() + w[i:j].tobytes()).digest() if k == j - i else None for i, j, k in zip(starts, ends, n_feat)]
    if len(ids) and ids[0] == NO_ID:  # has no features here
        ids, n_feat, wsum, alone, same, count = (x[1:] for x in (ids, n_feat, wsum, alone, same, count))
    return ids, n_feat, wsum, alone, same, np.concatenate([np.zeros(1, np.int64), np.cumsum(count)]), h, w, df


def _units(t: pa.Table) -> pa.Table:
    ids, n_feat, wsum, alone, same, start, h, w, df = _unit_arrays(t)
    lists = [pa.ListArray.from_arrays(start.astype(np.int32), pa.array(x)) for x in (h, w.astype(np.int32), df.astype(np.int32))]
    return pa.Table.from_arrays([pa.array(ids), pa.array(n_feat.astype(np.int32)), pa.array(wsum), pa.array(alone), pa.array(same, pa.binary()), *lists], ["fid", "n_feat", "wsum", "alone", "same", "h", "w", "df"])


def units_with_postings(features: DataFrame | None, texts: DataFrame | None = None, work=None) -> DataFrame:
    """A row for each unit of features (fid, h, w): fid, n_feat, wsum, alone (weight of the features that no other has), same (equal for equal units, else
    null or unequal), and h, w, df of the features of two units or more, the rarest first, ties to the smaller hash. The features are read once; repeated ones count once, with the largest weight.
    With texts (fid, text) their shingles are the features, made where they are dealt out. A workspace has what was counted written, and lets go of what was dealt out."""
    return _counts(features, texts, work).groupBy("bucket").applyInArrow(_units, UNITS)


def unit_blocks(features: DataFrame | None, texts: DataFrame | None, cutoff: int, prefix: float | None, work, among: DataFrame | None = None) -> DataFrame:
    """The units in blocks (tiles.py), written: a block for HELD features of several units, eight at least where there are many. With ``among`` (fid) only these units."""
    counted = _counts(features, texts, work)
    n, last = (x or 0 for x in counted.agg(F.sum(F.octet_length("df")), F.max("bucket")).first())
    n_blocks = max(min(8, 1 + n // (8 * FEW)), -(-n // (8 * HELD)))
    # as many buckets in one block as in another
    n_blocks = -(-(last + 1) // max(1, (last + 1) // n_blocks))
    at = F.pmod("bucket", F.lit(n_blocks))
    if among is None:

        def block(key: tuple, t: pa.Table) -> pa.Table:
            return block_of(key[0].as_py(), *_unit_arrays(t), cutoff, prefix)

        made = counted.withColumn("block", at).groupBy("block").applyInArrow(block, BLOCK)
    else:

        def of_rows(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks().sort_by("fid")
            lists = [t.column(c).combine_chunks() for c in ("h", "w", "df")]
            start = np.concatenate([np.zeros(1, np.int64), np.cumsum(lists[0].value_lengths().to_numpy())])
            plain = [t.column(c).to_numpy().astype(np.int64) for c in ("fid", "n_feat", "wsum", "alone")]
            return block_of(key[0].as_py(), *plain, t.column("same").to_pylist(), start, *[x.flatten().to_numpy().astype(np.int64) for x in lists], cutoff, prefix)

        units = counted.groupBy("bucket").applyInArrow(_units, UNITS).join(among.select("fid").distinct(), "fid", "left_semi")
        made = units.withColumn("block", F.pmod(F.xxhash64("fid"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(of_rows, BLOCK)
    blocks = work.keep(made, alone=True, rows=TEXTS)
    work.drop(counted)
    work.tidy()
    return blocks


def _counts(features: DataFrame | None, texts: DataFrame | None, work=None) -> DataFrame:
    """Rows of DEALT by buckets of ids: the features of several units with their frequencies, and sizes and weights of all units. Features are rows (fid, h, w), or rows with arrays h and w."""
    if texts is not None:
        rows = texts.select(F.coalesce(F.col("fid").cast("bigint"), F.lit(NO_ID)).alias("fid"), "text")
    else:
        listed = features.schema["h"].dataType.typeName() == "array"
        kind = "array<bigint>" if listed else "bigint"
        rows = features.where("h is not null").select(F.coalesce(F.col("fid").cast("bigint"), F.lit(NO_ID)).alias("fid"), F.col("h").cast(kind).alias("h"), F.col("w").cast(kind).alias("w"))
    shingled = texts is not None
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.rdd.getNumPartitions())

    def read(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        if not shingled and listed:
            h = batch.column("h")
            yield [np.repeat(batch.column("fid").to_numpy(), h.value_lengths().to_numpy()), h.flatten().to_numpy(), batch.column("w").flatten().to_numpy()]
            return
        if not shingled:
            yield [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            return
        ids = batch.column("fid").to_numpy()
        for k in range(0, batch.num_rows, TEXTS):
            place, h, w = shingles_of(batch.column("text").slice(k, TEXTS).to_pylist())
            yield [ids[k + place], h, w.astype(np.int64)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in read(batch):
                held.append(part)
                size += len(part[0])
                if size >= CHUNK:
                    yield _dealt(*map(np.concatenate, zip(*held)), n)
                    held, size = [], 0
        if size:
            yield _dealt(*map(np.concatenate, zip(*held)), n)

    def count(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_counted(t, n), schema=_rows([(0, 0, b"", b"", b"", b"")]).schema)

    counted = rows.mapInArrow(deal, DEALT).groupBy("bucket").applyInArrow(count, DEALT)
    if work is None:
        return counted
    counted = work.keep(counted, rows=TEXTS if shingled else None)
    work.tidy()
    return counted
