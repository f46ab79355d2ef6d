"""Best-fit packing by large-item matching.

Tokenising runs once, in Arrow batches, and yields small rows (no text, no ids); they are
stored. The packing is planned on the histogram of piece lengths, at most ``capacity`` numbers
however many documents there are, and the plan is a short table of runs: "the pieces of
length L ranked r to r + n go to sequences s, s + 1, ...". A piece finds its place by
its rank among the pieces of its length, a running count by input partition, so no step gathers
the pieces of one length or source in one task.
"""

from __future__ import annotations

import base64
import json
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, slices

CAPACITY = 1024
END = 2


def encoder(vocabulary: str):
    """The byte-level BPE of a vocabulary in public_tokenizers (ranks in NAME.tiktoken); one in each Python worker.

    Its ids are those of NAME.json, whose added tokens are matched in a text, at five times the speed.
    """
    # code arrives with each task, so what outlives a task is kept with the interpreter
    held = sys.modules.setdefault("_held_encoders", types.ModuleType("_held_encoders")).__dict__
    if vocabulary not in held:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json")) as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        held[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return held[vocabulary]


def encode(vocabulary: str, text: str) -> np.ndarray:
    """Ids of a text as little-endian 32-bit numbers."""
    return encoder(vocabulary).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def lengths_of(n: int, capacity: int) -> list[int]:
    """Piece lengths of n ids: whole ones, the first shorter if need be."""
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([END], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, at = encode(vocabulary, text or "").tobytes() + end, 0
                for k, n in enumerate(lengths_of(len(ids) // 4, capacity)):
                    for c, v in zip(cols, (doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), part, seen[n]), strict=True):
                        c.append(v)
                    seen[n] += 1
                    at += n
            kinds = (b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces of it in one sequence, offset).

    Large pieces (over a third of the capacity) come at most two to a sequence: the longest
    takes the longest that still fits. Each smaller length, longest first, then goes where it
    leaves the least gap, and opens sequences when nothing has room. Sequences that
    hold the same are one run, so the work doesn't depend on how many there are.
    """
    left, used, runs = dict(counts), defaultdict(int), []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, sequences)
    opened = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], n, first, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for x in large:
        while left[x] > 0:
            mate = next((y for y in large if y <= x and x + y <= capacity and left[y] > (y == x)), None)
            if mate is None:
                n = left[x]
                put(x, n, opened, 1, 0)
                gaps[capacity - x].append((opened, n))
            else:
                n = left[x] // 2 if mate == x else min(left[x], left[mate])
                put(x, n, opened, 1, 0)
                put(mate, n, opened, 1, x)
                gaps[capacity - x - mate].append((opened, n))
            opened += n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= x):
            while gaps[gap] and left[x] > 0:
                (first, n), each = gaps[gap].pop(), gap // x
                full = min(n, left[x] // each)
                if full:
                    put(x, full * each, first, each, capacity - gap)
                    gaps[gap - each * x].append((first, full))
                if full < n:
                    some = left[x] if left[x] < each else 0
                    if some:
                        put(x, some, first + full, some, capacity - gap)
                        gaps[gap - some * x].append((first + full, 1))
                    if full + bool(some) < n:
                        gaps[gap].append((first + full + bool(some), n - full - bool(some)))
            if not left[x]:
                break
        if left[x]:
            each = capacity // x
            full, some = divmod(left[x], each)
            if full:
                put(x, full * each, opened, each, 0)
                gaps[capacity - each * x].append((opened, full))
            if some:
                put(x, some, opened + full, some, 0)
                gaps[capacity - some * x].append((opened + full, 1))
            opened += full + bool(some)
    return runs


def pack(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one id (the end mark). Null ids stay null, repeated rows are packed as often as they stand there,
    and an empty table gives an empty result. Texts of any length are encoded whole; ids over the capacity are cut.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_pieces(vocabulary, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")
    pieces = scratch.keep(made)
    tally = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tally = scratch.keep(tally.withColumn("before", before))
    # at most ``capacity`` rows come to the driver, and the plan is checked before it is sent to all
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    if len(runs) > 64 * capacity:
        raise ValueError(f"the plan has {len(runs)} runs; a capacity of {capacity} should need far fewer")
    steps = scratch.spark.createDataFrame(runs, "run_length bigint, rank0 bigint, run_n bigint, seq0 bigint, each bigint, offset0 bigint")
    # the tally has a row for each length and partition, so it grows with the input: it is shuffled, never broadcast
    ranked = pieces.join(tally.select("length", "part", "before").hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(steps), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("run_n")))
    k = F.col("rank") - F.col("rank0")
    sequence = F.col("seq0") + F.floor(k / F.col("each")).cast("bigint")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("offset0") + (k % F.col("each")) * F.col("length")).alias("offset"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), Scratch(spark, "op1"))
