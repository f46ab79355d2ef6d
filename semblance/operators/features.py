"""Features of units: (fid, h, w), one row per distinct feature of a unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60, hash60_of
from ..functions.text import words


#: Texts whose shingles are made at a time.
TEXTS = 256
#: A cutoff that no frequency is above: every feature proposes candidates.
ALL = 1 << 40


def raw_shingle_features(units: DataFrame, *, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """A row per shingle occurrence; shingles with a digit weigh 5 tenths, others 10. Texts of fewer than n words have none.

    The words and those after them are laid side by side and dealt out as rows, so that all from there is compiled code on plain columns.
    """
    ws = units.select(F.col(id_col).alias("fid"), words(F.col(text_col)).alias("ws")).where(F.size("ws") >= n)
    count = F.size("ws") - (n - 1)
    rows = ws.select("fid", F.inline(F.arrays_zip(*[F.slice("ws", k + 1, count).alias(f"w{k}") for k in range(n)])))
    s = rows.select("fid", F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("s"))
    return s.select("fid", hash60(F.col("s")).alias("h"), F.when(F.col("s").rlike("[0-9]"), 5).otherwise(10).alias("w"))


def dedup_max(features: DataFrame) -> DataFrame:
    """One row per unit and feature, with its largest weight."""
    return features.groupBy("fid", "h").agg(F.max("w").alias("w"))


def shingles_of(texts: list[str | None], n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in texts, h, w) of the distinct shingles of each text, by place and hash."""
    words = [(t or "").encode().lower().split() for t in texts]  # both know ASCII only
    per = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    # one buffer with a blank after each word, so that a shingle is a slice of it
    data = np.frombuffer(b" ".join(flat) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(flat) else ends
    of = np.repeat(np.arange(len(words)), per)
    left = np.repeat(np.cumsum(per), per) - np.arange(len(flat))  # words from here to the end of the text
    at = np.flatnonzero(left >= n)
    start, end = starts[at], ends[at + n - 1] - 1
    digits = np.concatenate([np.zeros(1, np.int64), np.cumsum((data >= 48) & (data <= 57))])
    place, h = of[at], hash60_of(data, start, end)
    # eight texts at a time fit into one number with the hash and the weight
    key = ((place & 7) << 61 | h << 1 | (digits[end] == digits[start])).view(np.uint64)
    cuts = np.searchsorted(place, np.arange(0, len(words) + 8, 8))
    last = np.ones(len(h), bool)
    for i, j in zip(cuts, cuts[1:]):
        key[i:j].sort()
    last[:-1] = (key[1:] >> np.uint64(1)) != (key[:-1] >> np.uint64(1))
    last[cuts[1:-1][cuts[1:-1] > 0] - 1] = True
    place, key = place[last], key[last].view(np.int64)
    return place, key >> 1 & (1 << 60) - 1, np.where(key & 1, 10, 5).astype(np.int32)


def shingle_features(units: DataFrame, *, id_col: str = "fid", text_col: str = "text", n: int = 3, once: bool = False) -> DataFrame:
    """Features of texts. With ``once`` no id stands in two rows, so nothing is shuffled: each row's features are distinct by themselves."""
    rows = units.select(F.col(id_col).alias("fid"), F.col(text_col).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                place, h, w = shingles_of(part.column("text").to_pylist(), n)
                for i in range(0, len(h), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([part.column("fid").take(pa.array(place[j])), pa.array(h[j]), pa.array(w[j])], ["fid", "h", "w"])

    out = rows.mapInArrow(features, f"fid {rows.schema['fid'].dataType.simpleString()}, h bigint, w int")
    return out if once else dedup_max(out)


def document_frequency(features: DataFrame) -> DataFrame:
    return features.groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def df_cutoff(n_units: int) -> int:
    """Features of more units than this don't propose candidates by themselves."""
    return max(100, n_units // 50)


def signatures(features: DataFrame) -> DataFrame:
    """(fid, f): the nested form, sorted by hash."""
    return features.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("f"))
