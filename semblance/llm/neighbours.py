"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in halves and each half is quantised by a codebook of its own, fitted on a bounded
sample; every vector is filed under its pair of centroids. A query goes through the pairs in order of
summed distance (here the negated inner product of query and centroids) with a heap, until the
pairs it has seen hold enough entries, and those entries are reranked on the original vectors.

Queries and entries meet by first centroid, in GROUPS groups: a query is sent once to each group that it visits, with the
distance up to which it looks at second centroids under each first one, and an entry to its own. A group with very many
entries or visits is split in blocks of some BLOCK rows on either side, so that no task gets an unbounded group.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Vectors the codebooks are fitted on, at most; entries wanted in a pair of centroids; centroids of a half.
SAMPLE, OCCUPANCY, LEAST, MOST = 20_000, 1, 8, 1024
#: A query stops once the pairs it has seen hold this share of the index, and so many entries at least. Directions that are all
#: alike are the hardest case: of 51,282 in 64 dimensions with 256 centroids a half, shares of 0.1, 0.2, 0.25, 0.3, 0.4 and 0.55 find
#: 0.70, 0.86, 0.90, 0.93, 0.97 and 0.99 of the 20 nearest. Clustered vectors need far less (``probe``).
SHARE, PROBE = 0.35, 4_000
#: How far a pop of the heap may run ahead of the order of sums, as a share of the second half's range; groups of first centroids that meet together.
STRIDE, GROUPS = 0.03, 16
#: Rows of a block of queries, and of entries at most; share of the entries that a block holds at most if that leaves LEAST_BLOCK rows.
BLOCK, BLOCK_SHARE, LEAST_BLOCK = 20_000, 1 / 8, 500
#: Bytes of the sample at most; Lloyd's steps.
SAMPLE_BYTES, STEPS = 32 << 20, 12


def taking_part(vector: Column, dims: int) -> Column:
    """Vectors of the right length, without null or non-finite components, other than zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's steps; repeated rows count once."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(STEPS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), axis=1)


def traverse(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The first centroids that a query visits, and for each the largest distance of a second one that it goes to there.

    A heap holds for each first centroid taken up so far the next second one; what is popped are the pairs up to STRIDE
    beyond the next sum in the heap, so that a pop moves over a run of pairs. It ends when the pairs hold ``want`` entries.
    """
    cut = books[0].shape[1]
    d = [-(books[0] @ q[:cut]), -(books[1] @ q[cut:])]
    o = [np.argsort(x, kind="stable") for x in d]
    a, b = d[0][o[0]].tolist(), d[1][o[1]].tolist()
    held = np.zeros((len(a), len(b) + 1), np.int64)
    np.cumsum(counts[np.ix_(*o)], axis=1, out=held[:, 1:])
    stride, far = STRIDE * (b[-1] - b[0]), b[-1]
    gone, total = [0] * len(a), 0
    heap = [(a[0] + b[0], 0)]
    while heap and total < want:
        _, i = heapq.heappop(heap)
        at = gone[i]
        if at == 0 and i + 1 < len(a):  # the next first centroid enters when this one is taken up
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1))
        limit = (heap[0][0] if heap else a[i] + far) + stride - a[i]
        gone[i] = to = max(at + 1, bisect_right(b, limit, at))
        total += int(held[i, to] - held[i, at])
        if to < len(b):
            heapq.heappush(heap, (a[i] + b[to], i))
    rows = [i for i, n in enumerate(gone) if n and held[i, n]]
    return o[0][rows].astype(np.int32), np.array([b[gone[i] - 1] for i in rows])


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _file_batches(books, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = _matrix(b.column("vector"), dims).astype(np.float64)
            cells = [nearest(h, c).astype(np.int32) if len(x) else np.empty(0, np.int32) for h, c in ((x[:, : dims // 2], books[0]), (x[:, dims // 2 :], books[1]))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), *map(pa.array, cells)], ["vec_id", "vector", "c1", "c2"])

    return run


def _visit_batches(books, dims: int, counts: np.ndarray, want: int, width: int):
    """A row for each group of ``width`` first centroids that a query visits, with the limits of the second ones for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, group, limits = [], [], []
            for k, q in enumerate(_matrix(b.column("vector"), dims).astype(np.float64)):
                c1, most = traverse(q, books, counts, want)
                every = np.full(-(-len(books[0]) // width) * width, -np.inf)
                every[c1] = most
                for g in np.unique(c1 // width):
                    row.append(k)
                    group.append(g)
                    limits.append(every[g * width : (g + 1) * width])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("vector").take(at), pa.array(group, pa.int32()), pa.array(limits, pa.list_(pa.float64()))], ["vec_id", "vector", "c_group", "limits"])

    return run


def _rerank_batches(books, dims: int, k: int, width: int):
    """Rows come by block: its queries, then its entries in order of centroids and id."""
    cut = dims // 2

    class Block:
        def __init__(self):
            self.parts: list[tuple] = []
            self.ids = None

        def ask(self, ids: np.ndarray, x: np.ndarray, limits: np.ndarray) -> None:
            self.parts.append((ids, x, limits))

        def ready(self) -> None:
            if self.ids is None:
                self.ids, self.x, self.limits = (np.concatenate(p) for p in zip(*self.parts, strict=True))
                self.score, self.found = np.full((len(self.ids), k), -np.inf), np.zeros((len(self.ids), k), np.int64)

        def rank(self, c1: int, c2: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            """Takes entries of one first centroid into the k best of each query that looks at them; of equal scores the smaller id goes first."""
            asking = np.flatnonzero(self.limits[:, c1 % width] > -np.inf)
            if not len(asking):
                return
            limit, s = self.limits[asking, c1 % width], np.full((len(asking), len(ids)), -np.inf)
            cuts = np.append(0, np.flatnonzero(np.diff(c2)) + 1)
            # rounding may differ from that of the traversal, so a hair more is looked at
            under = -(self.x[asking, cut:] @ books[1][c2[cuts]].T) <= (limit + 1e-9 * (1 + np.abs(limit)))[:, None]
            for c, (a, e) in enumerate(zip(cuts, np.append(cuts[1:], len(c2)), strict=True)):
                looking = np.flatnonzero(under[:, c])
                # not through a matrix product: equal vectors must get equal scores wherever they stand
                s[looking, a:e] = np.einsum("ij,kj->ik", self.x[asking[looking]], x[a:e], optimize=False)
            s[self.ids[asking][:, None] == ids[None, :]] = -np.inf
            better = s.max(axis=1) >= self.score[asking, -1]
            asking, s = asking[better], np.hstack([self.score[asking[better]], s[better]])
            i = np.hstack([self.found[asking], np.broadcast_to(ids, (len(asking), len(ids)))])
            o = np.lexsort((i, -s), axis=1)[:, :k]
            self.score[asking], self.found[asking] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)

        def result(self) -> pa.RecordBatch:
            self.ready()
            got = np.isfinite(self.score)
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.ids[:, None], got.shape)[got]), pa.array(self.found[got]), pa.array(self.score[got])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block()
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("c_group", "entry_block", "query_block", "c1")], axis=1)
            x, ids, c2 = _matrix(b.column("vector"), dims).astype(np.float64), b.column("vec_id").to_numpy(), b.column("c2").to_numpy()
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for s, e in zip(np.append(0, cuts), np.append(cuts, len(keys)), strict=True):
                if s == e:
                    continue
                if tuple(keys[s, :3]) != now:
                    if block.parts:
                        yield block.result()
                    now, block = tuple(keys[s, :3]), Block()
                if keys[s, 3] < 0:
                    block.ask(ids[s:e], x[s:e], b.column("limits").slice(s, e - s).flatten().to_numpy().reshape(-1, width))
                elif block.parts:
                    block.ready()
                    step = max(k, (1 << 20) // len(block.ids))
                    for at in range(s, e, step):
                        to = min(e, at + step)
                        block.rank(int(keys[s, 3]), c2[at:to], ids[at:to], x[at:to])
        if block.parts:
            yield block.result()

    return run


def nearest_neighbours(vectors: DataFrame, scratch: Scratch, *, id_col="vec_id", vector_col="embedding", is_query=None, k: int = 20, probe=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k entries of largest inner product found, nearest first, ties to the smaller id.

    Queries are the rows for which is_query(id) holds (default: id divisible by 20), entries all rows but the query's own id. Null ids, and vectors
    that are null, zero, of another length than most, or hold null or non-finite components take no part. Repeated rows are entries
    of their own and one query; if rows of one id hold different vectors, the one of least hash asks. An empty table gives an empty result. The codebooks are fitted on at most SAMPLE vectors of SAMPLE_BYTES together, the first in hash order of their ids.
    """
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    most = rows.groupBy(F.size("vector").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").limit(1).collect()
    if not most:
        return scratch.spark.createDataFrame([], empty)
    dims = most[0]["d"]
    rows = rows.where(taking_part(F.col("vector"), dims))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vector")).limit(min(SAMPLE, SAMPLE_BYTES // (8 * dims) + 1)).select("vector").toArrow()
    if not sample.num_rows:
        return scratch.spark.createDataFrame([], empty)
    x = _matrix(sample.column("vector").combine_chunks(), dims).astype(np.float64)
    n = rows.count()
    size = int(np.clip(2 ** round(np.log2(max(1.0, (n / OCCUPANCY) ** 0.5))), LEAST, min(MOST, max(LEAST, len(x) // 16))))
    books = (codebook(x[:, : dims // 2], size, 1), codebook(x[:, dims // 2 :], size, 2)) if dims > 1 else (np.zeros((1, 0)), codebook(x, size, 2))
    filed = scratch.keep(rows.mapInArrow(_file_batches(books, dims), "vec_id bigint, vector array<double>, c1 int, c2 int").withColumn("row", F.monotonically_increasing_id()))
    # at most as many rows as there are pairs of centroids, whatever the input
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    cells = filed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts[cells.column("c1").to_numpy(), cells.column("c2").to_numpy()] = cells.column("n").to_numpy()
    want, width = probe or max(PROBE, int(SHARE * n)), -(-len(books[0]) // GROUPS)
    chosen = is_query(F.col("vec_id")) if is_query else F.col("vec_id") % 20 == 0
    # of the rows of one id the vector of least hash asks; few rows that each take long are dealt out to all tasks
    asking = filed.where(chosen).groupBy("vec_id").agg(F.min_by("vector", F.struct(F.xxhash64("vector"), "vector")).alias("vector"))
    asking = asking.repartition(_tasks(scratch.spark))
    visits = scratch.keep(asking.mapInArrow(_visit_batches(books, dims, counts, want, width), "vec_id bigint, vector array<double>, c_group int, limits array<double>"))

    asked = visits.groupBy("c_group").agg(F.count(F.lit(1)).alias("n")).collect()
    in_group = np.add.reduceat(counts.sum(axis=1), np.arange(0, len(counts), width))
    entries = min(BLOCK, max(LEAST_BLOCK, int(n * BLOCK_SHARE)))
    blocks = [(r["c_group"], -(-r["n"] // BLOCK), -(-int(in_group[r["c_group"]]) // entries)) for r in asked]
    shape = F.broadcast(scratch.spark.createDataFrame(blocks, "c_group int, query_blocks int, entry_blocks int"))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(-1)
    left = visits.join(shape, "c_group").withColumn("query_block", block("query_blocks")).withColumn("entry_block", every("entry_blocks")).withColumn("c1", none).withColumn("c2", none)
    right = filed.withColumn("c_group", F.floor(F.col("c1") / width).cast("int")).join(shape, "c_group")
    # by a hash of the row too: many rows of one id are dealt to all blocks
    right = right.withColumn("entry_block", F.pmod(F.xxhash64("vec_id", "row"), F.col("entry_blocks")).cast("int")).withColumn("query_block", every("query_blocks")).withColumn("limits", F.lit(None).cast("array<double>"))
    columns = ["c_group", "entry_block", "query_block", "c1", "c2", "vec_id", "vector", "limits"]
    both = left.select(columns).unionByName(right.select(columns))
    key = ["c_group", "entry_block", "query_block"]
    met = both.repartition(_tasks(scratch.spark), *key).sortWithinPartitions(*key, "c1", "c2", "vec_id")
    found = met.mapInArrow(_rerank_batches(books, dims, k, width), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op3"))
