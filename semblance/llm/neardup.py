"""Near-duplicates by b-bit MinHash.

One pass over the texts yields a row per document: the digest of its shingle set, the keys of
bands of minima and a signature that keeps BITS low bits of each minimum. Documents of
equal sets become one class, whose node is the number of one of its rows; ids play no part until the end. Classes that share a band are candidates; the similarity of a
candidate pair is estimated by counting equal signature fields and correcting for those that agree by chance,
and pairs whose estimate is within SLACK of the threshold are confirmed on full sets.

Counts of shingles in hash cells bound the intersection exactly and set most of the pairs below the
threshold aside. No bucket is ever turned into all its pairs. Every member is first held against one pivot. Where a bucket
then holds several components, those outside the most frequent one meet a member of it; what is
still in different components of a bucket is compared across components, so that no
link that could join them is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, slices
from .components import components
from .text import BASE, mix64, shingle_set

#: Words in a shingle; minima; low bits kept; bits in a word of the signature.
SHINGLE, MINIMA, BITS, WORD_BITS = 5, 128, 4, 64


class Threshold(NamedTuple):
    """Link if 100 * intersection >= percent * union.

    Minima in each of the bands, and bands: a pair at the threshold misses all of them with probability 4e-7.
    slack is how far an estimate may fall below the threshold: over five of its standard errors.
    """

    percent: int
    rows: int
    bands: int
    slack: float


#: The threshold of op4.
PERCENT = 85
OP4 = Threshold(PERCENT, 5, 25, 0.17)
#: The threshold of the pipeline's stage.
STAGE = Threshold(80, 4, 28, 0.19)
#: Ids with hashes up to this number (16 bytes each) are broadcast to pick out texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Shuffles the order of ids by which pivots are chosen.
MASK = 0x5A17_3C69_0F2D_4B8E
_rng = np.random.default_rng(7)
FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = [f"g{k}" for k in range(MINIMA * BITS // WORD_BITS)]
#: Hash cells of a set; counts up to LEVELS are kept, as a bit for each cell and level, and what is over in sum.
CELL_BITS, LEVELS = 9, 2
CELLS = [f"t{k}" for k in range(LEVELS * (1 << CELL_BITS) // WORD_BITS)]
MARKS = [*SIGNATURE, *CELLS, "over"]


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set; sets of any size in bounded memory."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(out, (s[at : at + 1024, None] * FACTORS[None, :]).min(axis=0), out=out)
    return mix64(out)


def band_keys(m: np.ndarray, at: Threshold) -> np.ndarray:
    rows = m[: at.rows * at.bands].reshape(at.bands, at.rows)
    key = np.arange(1, at.bands + 1, dtype=np.uint64)
    for k in range(at.rows):
        key = mix64(key * BASE + rows[:, k])
    return key.view(np.int64)


def signature(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into words."""
    per = WORD_BITS // BITS
    fields = (m & np.uint64((1 << BITS) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(fields, axis=1).view(np.int64)


def cells(s: np.ndarray) -> np.ndarray:
    """Bits of the cells with at least 1, at least 2, ... shingles, packed into words; last, the number beyond LEVELS."""
    counts = np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    bits = np.concatenate([counts >= k for k in range(1, LEVELS + 1)])
    return np.append(np.packbits(bits).view(np.int64), np.maximum(counts - LEVELS, 0).sum())


def _sketcher(at: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, digests, bands, marks = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, SHINGLE)
                n.append(len(s))
                digests.append(digest(s))
                m = minima(s)
                bands.append(band_keys(m, at) if len(s) else None)
                marks.append(np.concatenate([signature(m), cells(s)]))
            digests, marks = np.array(digests).reshape(-1, 2), np.array(marks).reshape(-1, len(MARKS))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), *map(pa.array, np.ascontiguousarray(digests.T)), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(marks.T))],
                ["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands", *MARKS],
            )

    return sketch_batches


def digest(s: np.ndarray) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingle_set(t, SHINGLE) for t in b.column("text").to_pylist()]
        d = np.array([digest(s) for s in sets]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(d.T)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["s1", "s2", "shingles"])


def estimate(a: str, b: str) -> Column:
    """Similarity of the sets behind two signatures: the share of equal fields, less those equal by chance."""
    ones = F.lit(sum(1 << k for k in range(0, WORD_BITS, BITS)))
    differ = F.lit(0)
    for g in SIGNATURE:
        x = F.col(f"{a}.{g}").bitwiseXOR(F.col(f"{b}.{g}"))
        for k in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    same, chance = 1.0 - differ / MINIMA, 2.0**-BITS
    return (same - chance) / (1 - chance)


def comparable(a: str, b: str, at: Threshold) -> Column:
    """What a pair must meet to be confirmed: the bound by hash cells, and the estimate.

    In each cell the intersection has no more shingles than the set with fewer there: an exact bound.
    """
    most = F.least(f"{a}.over", f"{b}.over")
    for t in CELLS:
        most = most + F.bit_count(F.col(f"{a}.{t}").bitwiseAND(F.col(f"{b}.{t}")))
    return (100 * most >= at.percent * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles") - most)) & (estimate(a, b) >= at.percent / 100 - at.slack)


def confirmed(pairs: DataFrame, sets: DataFrame, at: Threshold) -> DataFrame:
    """Of pairs(a, b) those whose full sets (node, shingles) are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u")).where(100 * F.col("i") >= at.percent * F.col("u")).select("a", "b")


def near_duplicates(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", at: Threshold = OP4) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and link with nothing. Rows are documents of their own, those of null or repeated ids
    too: component_id is the smallest id in the component (null if it has none), and kept is false where a row has another id or
    none. So repeated rows of the smallest id are all kept. An empty table gives an empty result.
    """
    members, roots = groups(docs, scratch, id_col=id_col, text_col=text_col, at=at)
    out = members.join(roots, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(component.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"))


def groups(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", at: Threshold = OP4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of each row, node null without shingles; and (node, root, component_id) of each node."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kinds = "doc_id bigint, text_hash bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, " + ", ".join(f"{g} bigint" for g in MARKS)
    sketches = scratch.keep(rows.mapInArrow(_sketcher(at), kinds).withColumn("row", F.monotonically_increasing_id()))
    real = sketches.where("n_shingles > 0")
    # what sums rows up is written before it is joined: then both sides are plain shuffles, and a hot key can be split
    classes = scratch.keep(real.groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id")))
    nodes = scratch.keep(real.join(classes.select("node"), F.col("row") == F.col("node")).select("node", "s1", "s2", "doc_id", "text_hash", "n_shingles", "bands", *MARKS))
    members = scratch.keep(sketches.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "text_hash", "n_shingles", "node"))
    scratch.drop(sketches)

    in_bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = scratch.keep(_buckets(in_bands, scratch).distinct())
    sets = scratch.keep(_sets_of(rows, nodes.select("node", "s1", "s2", "doc_id", "text_hash").join(shared.select("node").distinct(), "node"), scratch))
    marks = nodes.drop("bands", "s1", "s2", "doc_id", "text_hash")
    shared_pivots = shared.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))

    # the pivot met in most bands, for each member
    first = shared_pivots.groupBy("node").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    tried = scratch.keep(_likely(first, marks, at))
    links = scratch.keep(confirmed(tried, sets, at))
    roots = components(links, scratch)

    # buckets that still hold several components: who is not of the most frequent one meets a member of that
    placed, main = _split(shared, roots, scratch)
    lead = placed.join(main, "band").where("root <> main").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    second = scratch.keep(_likely(lead.join(tried, ["a", "b"], "left_anti"), marks, at))
    links = scratch.keep(links.unionByName(confirmed(second, sets, at)))
    roots = components(links, scratch)

    # and what even so is in several components is compared across them
    placed, main = _split(shared, roots, scratch)
    split = scratch.keep(placed.join(main.select("band", "main"), "band").join(marks, "node"))
    across = split.where("root <> main").alias("x").join(split.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root")) & comparable("x", "y", at))
    pairs = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    seen = tried.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    last = scratch.keep(confirmed(pairs.join(seen, ["a", "b"], "left_anti"), sets, at))
    if not last.isEmpty():
        links = scratch.keep(links.unionByName(last))
        roots = components(links, scratch)
    # the least id of a class, then of a component
    least = classes.select("node", "least_id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least_id")
    least = scratch.keep(least)
    by_root = scratch.keep(least.groupBy("root").agg(F.min("least_id").alias("component_id")))
    scratch.drop(sets, nodes, classes)
    return members, least.join(by_root, "root").select("node", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, *, at: Threshold = OP4) -> DataFrame:
    """docs (with columns doc_id and text, among any others), with all its columns: of each group of near-duplicates one row.

    That of least id stays (null last), of several texts under it the one of least hash, and of rows equal in both
    any one. What has no words is no duplicate and stays, repeated rows too. An empty table stays empty.
    """
    members, roots = groups(docs, scratch, at=at)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")
    stay = members.where("node is not null").join(roots.select("node", "root"), "node").groupBy("root").agg(first).select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash"))
    stay = scratch.keep(stay.distinct())
    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    of_groups = hashed.where(worded).join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    return of_groups.unionByName(hashed.where(~worded)).select(docs.columns)


def _buckets(in_bands: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, pivot) of bands with several nodes. The pivot is the least id after a fixed shuffle of the bits: the same in most buckets of a large group."""
    masked = F.col("node").bitwiseXOR(F.lit(MASK))
    pivots = in_bands.groupBy("band").agg(F.min(masked).alias("least"), F.max(masked).alias("most")).where("least < most")
    pivots = scratch.keep(pivots.select("band", F.col("least").bitwiseXOR(F.lit(MASK)).alias("pivot")))
    return in_bands.join(pivots, "band").select("band", "node", "pivot")


def _likely(pairs: DataFrame, marks: DataFrame, at: Threshold) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    return pairs.join(marks.alias("x"), F.col("a") == F.col("x.node")).join(marks.alias("y"), F.col("b") == F.col("y.node")).where(comparable("x", "y", at)).select("a", "b")


def _split(shared: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with their components; and of buckets with several the most frequent one and its lead."""
    placed = shared.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("node").bitwiseXOR(F.lit(MASK))).bitwiseXOR(F.lit(MASK)).alias("lead"))
    main = counts.groupBy("band").agg(F.max_by(F.struct("root", "lead"), F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return placed, scratch.keep(main.select("band", F.col("m.root").alias("main"), F.col("m.lead").alias("lead")))


def _sets_of(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, shingles) of wanted(node, s1, s2, doc_id, text_hash): texts are found by id and hash, sets by digest."""
    wanted = scratch.keep(wanted)
    keys = wanted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    texts = rows.join(keys, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = texts.mapInArrow(_set_batches, "s1 bigint, s2 bigint, shingles array<bigint>").dropDuplicates(["s1", "s2"])
    return sets.join(wanted, ["s1", "s2"]).select("node", "shingles")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), Scratch(spark, "op4"))


OP4_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= {SHINGLE} then list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= {PERCENT} * (x.n + y.n - i)),
both_ways as (select a, b from link union all select b, a from link),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, both_ways.b from reach join both_ways on both_ways.a = reach.b),
least_of as (select a, min(b) as c from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, coalesce(doc_id = c, true) as kept from documents left join n using (doc_id) left join least_of on a = doc_id
"""
