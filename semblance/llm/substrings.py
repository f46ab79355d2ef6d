"""Removing repeated passages: every byte covered by a string of LENGTH bytes that starts twice.

The corpus is dealt out by content. In every window of LENGTH bytes the GRAM-byte string of
least hash, the leftmost of equals, is its anchor; equal windows have equal anchors, so windows whose anchor
occurs once in the corpus can't repeat and are left alone. For the others, the
windows of one anchor occurrence (a contiguous range) form a segment, and every window of
the corpus is in exactly one segment. Segments of equal anchors meet in one task, where a
run-length index (runindex.py) over them gives matching statistics, and long matches are marked.

Hot anchors: equal segments are known by digest and sent at most twice by a task (the index needs one copy and to
know of a second); segments of an anchor with over HOT occurrences are cut in pieces that are dealt out by a core of
LENGTH - PIECE + 1 bytes, so that only windows that share almost everything still meet. Where over WIDE distinct pieces
share even that (one core between very many different bytes), they are cut again, in pieces of fewer windows with longer
cores, down to single windows, which share all. So no index ever holds more than WIDE distinct pieces of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices
from .runindex import repeated
from .text import BASE, BYTE_KEYS

LENGTH, GRAM = 200, 64
#: Windows scanned at once; occurrences from which an anchor is hot; windows in a piece of a hot segment.
BLOCK, HOT, PIECE = 1 << 19, 5_000, 16
#: Segments or pieces over which a group is cut again; windows in the pieces of each cut.
WIDE, WIDTHS = 1_000, (PIECE, 4, 1)
#: Bytes from which an index is closed (it takes whole groups, of WIDE segments at most); segments that a task remembers; bytes of segments in an Arrow batch.
INDEX_BYTES, REMEMBERED, BATCH_BYTES = 1 << 20, 500_000, 8 << 20


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte string of a, by doubling."""
    h, width, power = BYTE_KEYS[a], 1, BASE
    out, done = None, 0
    while True:
        if k & width:
            if out is None:
                out = h
            else:
                n = min(len(h), len(out) - width) if len(out) > width else 0
                out = h[:n] * _power(done) + out[width : width + n]
            done += width
        if 2 * width > k:
            break
        h = h[: max(0, len(h) - width)] * power + h[width:]
        power = np.uint64((int(power) * int(power)) & (2**64 - 1))
        width *= 2
    return out * np.uint64(0xD6E8FEB86659FD93)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in turn."""
    width = 1
    while 2 * width <= w:
        g = np.minimum(g[: len(g) - width], g[width:])
        width *= 2
    rest = w - width
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window of each anchor occurrence; the ranges of windows partition them all."""
    parts: list[tuple] = []
    n, span = len(data) - length + 1, length - gram + 1
    for at in range(0, max(0, n), BLOCK):
        m = min(BLOCK, n - at)
        g = gram_hashes(np.frombuffer(data, np.uint8, m + length - 1, at), gram)
        low = np.uint64((1 << 20) - 1)
        keyed = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        place = (sliding_min(keyed, span) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:] - 1, m - 1)
        parts.append((g[place[first]].view(np.int64), place[first] + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    for t in column.to_pylist():
        yield (t or "").encode("utf-8", "surrogatepass")


def _anchor_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [anchors(x, length, gram) for x in _bytes_of(b.column("text"))]
            lens = [len(f[0]) for f in found]
            h, place, first, last = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(4))
            keys = [pa.array(np.repeat(b.column(k).to_numpy(zero_copy_only=False), lens)) for k in ("k1", "k2")]
            # first window, then how far the anchor and the last window are from it
            yield pa.RecordBatch.from_arrays([pa.array(h), *keys, pa.array((first << 32) | ((place - first) << 16) | (last - first))], ["anchor", "k1", "k2", "at"])

    return run


def digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def pieces_of(data: bytes, place: int, first: int, last: int, width: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(group, first window, last window) of the pieces of ``width`` windows that the windows first to last of an anchor at ``place`` fall in.

    Pieces lie at multiples of the width before the anchor, wherever a segment starts: equal windows have equal anchors, so
    they are in pieces of one number, and share the core, which all windows of such a piece cover.
    """
    for j in range((place - last) // width, (place - first) // width + 1):
        core = place - j * width
        lo, hi = max(first, core - width + 1), min(last, core)
        if lo <= hi:
            yield digest(b"%d,%d:" % (width, j) + data[core : core - width + 1 + length]), lo, hi


def _segment_batches(length: int):
    names = ["anchor", "digest", "width", "before", "k1", "k2", "first", "sent", "bytes", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        texts: set[tuple[int, int]] = set()
        cols: list[list] = [[] for _ in names]
        held = 0
        for b in slices(batches):
            for k1, k2, copies, marks, data in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "copies", "marks")), _bytes_of(b.column("text")), strict=True):
                if copies > 1:
                    if (k1, k2) in texts:
                        continue  # a copy of a text that this task has sent as occurring twice
                    texts.add((k1, k2))
                if len(sent) > REMEMBERED:
                    sent.clear()
                if len(texts) > REMEMBERED:
                    texts.clear()
                times = 2 if copies > 1 else 1
                for mark in marks:
                    at, hot = mark["at"], mark["hot"]
                    first, place, last = at >> 32, (at >> 32) + (at >> 16 & 0xFFFF), (at >> 32) + (at & 0xFFFF)
                    for group, lo, hi in pieces_of(data, place, first, last, PIECE, length) if hot else ((mark["anchor"], first, last),):
                        x = data[lo : hi + length]
                        key = (group, digest(x))
                        already = sent.get(key, 0)
                        if already < 2:
                            sent[key] = already + times
                            held += len(x)
                        for c, v in zip(cols, (*key, PIECE if hot else length, place - lo, k1, k2, lo, already < 2, x if already < 2 else None, times), strict=True):
                            c.append(v)
                if held >= BATCH_BYTES or len(cols[0]) >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                    cols, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _index_batches(length: int):
    def marked(groups: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        """Ranges of repeated windows of each distinct segment."""
        found = repeated([x for _, _, x, _ in groups], length, [times for *_, times in groups]) if groups else []
        out = ([], [], [])
        for (anchor, d, _, _), at in zip(groups, found, strict=True):
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                edges = np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]], axis=1)
                for c, v in zip(out, (anchor, d, edges.ravel()), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["anchor", "digest", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of anchor and digest; an index takes whole anchors."""
        groups: list[tuple[int, int, bytes, int]] = []
        held, anchor_now = 0, None
        for b in slices(batches):
            for anchor, d, x, times in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "bytes", "times")), strict=True):
                if groups and groups[-1][:2] == (anchor, d):
                    groups[-1] = (anchor, d, groups[-1][2], groups[-1][3] + times)
                    continue
                if anchor != anchor_now and held >= INDEX_BYTES:
                    yield marked(groups)
                    groups, held = [], 0
                anchor_now = anchor
                groups.append((anchor, d, x, times))
                held += len(x)
        yield marked(groups)

    return run


def _again_batches(length: int):
    """Segments or pieces cut in pieces of the next width: each with its group and digest, and its place in what it was cut from."""
    names = ["anchor", "digest", "group", "piece", "width", "before", "at", "bytes", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list] = [[] for _ in names]
            for anchor, d, width, before, x, times in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "width", "before", "bytes", "times")), strict=True):
                narrower = next(w for w in (*WIDTHS, 1) if w < width or w == 1)
                for group, lo, hi in pieces_of(x, before, 0, len(x) - length, narrower, length):
                    y = x[lo : hi + length]
                    for c, v in zip(cols, (anchor, d, group, digest(y), narrower, before - lo, lo, y, times), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def repeated_windows(sent: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(anchor, digest, edges) of segments and pieces sent(anchor, digest, width, before, bytes, times): ranges of windows that repeat.

    Each round indexes the groups of up to WIDE rows and cuts the others again; single windows end it.
    """
    found, came = None, None  # came: what a piece was cut from, and where it lies there
    for _ in range(len(WIDTHS) + 1):
        wide = scratch.keep(sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("anchor"))
        dealt = sent.select("anchor", "digest", "bytes", "times").join(wide, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "digest")
        edges = dealt.mapInArrow(_index_batches(length), "anchor bigint, digest bigint, edges array<bigint>")
        if came is not None:
            on = (F.col("anchor") == F.col("group")) & (F.col("digest") == F.col("piece"))
            edges = edges.join(came, on).select("from_anchor", "from_digest", F.transform("edges", lambda x: x + F.col("at")).alias("edges")).toDF("anchor", "digest", "edges")
        found = edges if found is None else found.unionByName(edges)
        if wide.isEmpty():
            break
        cut = sent.join(wide, "anchor", "left_semi").mapInArrow(_again_batches(length), "anchor bigint, digest bigint, group bigint, piece bigint, width int, before int, at bigint, bytes binary, times int")
        cut = scratch.keep(cut)
        step = cut.select("anchor", "digest", "group", "piece", "at").distinct()
        if came is None:
            came = step.select(F.col("anchor").alias("from_anchor"), F.col("digest").alias("from_digest"), "group", "piece", "at")
        else:
            back = came.select("from_anchor", "from_digest", F.col("group").alias("anchor"), F.col("piece").alias("digest"), F.col("at").alias("outer"))
            came = step.join(back, ["anchor", "digest"]).select("from_anchor", "from_digest", "group", "piece", (F.col("outer") + F.col("at")).alias("at"))
        came = scratch.keep(came)
        # equal pieces are summed up before they meet
        sent = scratch.keep(cut.groupBy("group", "piece", "width", "before").agg(F.first("bytes").alias("bytes"), F.sum("times").cast("int").alias("times")).withColumnsRenamed({"group": "anchor", "piece": "digest"}))
    return found


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for spans, data in zip(b.column("spans").to_pylist(), _bytes_of(b.column("text")), strict=True):
            kept, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if s > end:
                    runs += 1
                    kept.update(data[at:s])
                    at = s
                removed += max(0, e - max(s, at))
                at = end = max(at, e)
            kept.update(data[at:])
            for c, v in zip(out, (len(data), removed, runs, kept.hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, scratch: Scratch, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans) of docs(k1, k2, text): the byte ranges of each distinct text that repeat."""
    found = scratch.keep(docs.mapInArrow(_anchor_batches(length, gram), "anchor bigint, k1 bigint, k2 bigint, at bigint"))
    # written, so that the join reads two plain shuffles and a hot anchor can be split
    many = scratch.keep(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marks = found.join(many, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "at", (F.col("n") > HOT).alias("hot"))).alias("marks"), F.count(F.lit(1)).alias("all"))
    marks = marks.select("k1", "k2", "marks", (F.col("all") / F.size("marks")).cast("int").alias("copies"))
    with_text = docs.join(marks, ["k1", "k2"]).select("k1", "k2", "copies", "marks", "text")
    segments = scratch.keep(with_text.mapInArrow(_segment_batches(length), "anchor bigint, digest bigint, width int, before int, k1 bigint, k2 bigint, first bigint, sent boolean, bytes binary, times int"))
    scratch.drop(found, many)
    sent = segments.where("sent").select("anchor", "digest", "width", "before", "bytes", "times")
    long = repeated_windows(sent, scratch, length)
    at = segments.select("anchor", "digest", "k1", "k2", "first").join(long, ["anchor", "digest"])
    pairs = F.sequence(F.lit(0), (F.size("edges") / 2 - 1).cast("int"))
    at = at.select("k1", "k2", "first", "edges", F.explode(pairs).alias("p"))
    s, e = F.col("first") + F.get("edges", 2 * F.col("p")), F.col("first") + F.get("edges", 2 * F.col("p") + 1) + length
    spans = scratch.keep(at.groupBy("k1", "k2").agg(F.collect_set(F.struct(s.alias("s"), e.alias("e"))).alias("spans")))
    scratch.drop(segments)
    return spans


def remove_repeats(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty; texts shorter than ``length`` lose nothing. Repeated rows are documents of their own and so repeat each
    other; ids play no part. ``length`` may be up to 64K and should be three times ``gram`` or so.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", *text_key(F.col("text")), "text")
    spans = repeated_spans(keyed.drop("doc_id"), scratch, length=length, gram=gram)
    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_cut_batches, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), Scratch(spark, "op2"))


OP2_SQL = f"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
n as (select *, length(hx) // 2 as n from d),
blocks as (select r, n, b, substr(hx, {2 * LENGTH} * b + 1, {4 * LENGTH}) as part from (select r, n, hx, unnest(range(0, n // {LENGTH} + 1)) as b from n where n >= {LENGTH})),
win as (select r, {LENGTH} * b + j as i, md5(substr(part, 2 * j + 1, {2 * LENGTH})) as k from (select r, n, b, part, unnest(range(0, {LENGTH})) as j from blocks) where {LENGTH} * b + j + {LENGTH} <= n),
rep as (select k from win group by k having count(*) > 1),
starts as (select r, i, i > coalesce(lag(i) over (partition by r order by i) + {LENGTH}, -1) as fresh from win join rep using (k)),
runs as (select r, min(i) as s, max(i) + {LENGTH} as e from (select *, sum(fresh::int) over (partition by r order by i) as run from starts) group by r, run),
cuts as (select r, s, e, coalesce(lag(e) over (partition by r order by s), 0) as before from runs),
cut as (select r, sum(e - s)::bigint as removed, count(*)::bigint as spans, string_agg(substr(hx, 2 * before + 1, 2 * (s - before)), '' order by s) || substr(any_value(hx), 2 * max(e) + 1) as kept from cuts join d using (r) group by r)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, hx))) as kept_sha256 from n left join cut using (r)
"""
