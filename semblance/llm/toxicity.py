"""Toxicity as ordinal regression with cumulative links.

One weight vector over sparse word features serves all thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x), thresholds in order. The labels say toxic or not; a
toxic row's grade (1 to GRADES - 1) is the quantile of the number of its words that go with toxicity.
The model is fitted on the driver from at most SAMPLE labelled rows, one for each of the first ids in hash
order; scoring maps over all documents in Arrow batches with the model in the closure, whose size is
fixed by BUCKETS, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, slices
from .text import NOT_ALNUM, word_hashes

#: Labelled rows that the model is fitted on, at most; hashed feature space; features and grades of the model.
SAMPLE, BUCKETS, FEATURES, GRADES = 20_000, 1 << 18, 1024, 4
#: Least document frequency and standard score of a feature; ridge penalty; steps of the fit.
MIN_DF, MIN_SCORE, RIDGE, STEPS = 4, 4.0, 1e-4, 400
#: A document is toxic from this probability of any grade above 0; clean ones stay near the base rate of a few hundredths.
REJECT = 0.3


@dataclass
class Severity:
    """A fitted model: feature number by bucket (-1: none), weights, thresholds in order."""

    feature: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, x: np.ndarray) -> np.ndarray:
        """P(grade = k) for each w.x."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))
        edges = np.hstack([np.zeros((len(x), 1)), below, np.ones((len(x), 1))])
        return np.diff(edges, axis=1)

    def tilt(self, text: str | None) -> float:
        """w.x of a text, from the few features that it has."""
        k = self.feature[(word_hashes(text, NOT_ALNUM) % np.uint64(BUCKETS)).astype(np.int64)]
        known, n = np.unique(k[k >= 0], return_counts=True)
        return float(self.weights[known] @ np.log1p(n))

    def of(self, texts: pa.Array) -> np.ndarray:
        """P(grade = k) for each text; a text at a time is held as a string."""
        return self.grades(np.array([self.tilt(t.as_py()) for t in texts], float))


COUNTS = "toxic int, buckets array<int>, counts array<int>"


def _counted(toxic: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lists = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([toxic, *lists], ["toxic", "buckets", "counts"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield _counted(b.column("toxic"), [np.unique((word_hashes(t.as_py(), NOT_ALNUM) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True) for t in b.column("text")])


def _chosen_batches(feature: np.ndarray):
    """The entries of a text that are features, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for x, n in zip(b.column("buckets"), b.column("counts"), strict=True):
                k, n = feature[x.values.to_numpy()], n.values.to_numpy()
                found.append((k[k >= 0], n[k >= 0]))
            yield _counted(b.column("toxic"), found)

    return run


def fit(labelled: DataFrame) -> Severity:
    """Fits labelled(text, toxic) of at most SAMPLE rows; more are refused. Without toxic and other rows, nothing is toxic.

    Rows of null label don't count; null texts have no words. The rows are counted once and written; the driver gets the sums of the buckets
    (BUCKETS at most) and then only the entries of the FEATURES chosen by them.
    """
    scratch = Scratch(labelled.sparkSession, "toxicity")
    rows = labelled.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    counted = scratch.keep(rows.mapInArrow(_count_batches, COUNTS))
    bad = F.count_if(F.col("toxic") > 0).alias("bad")
    total = counted.agg(F.count(F.lit(1)).alias("n"), bad).first()
    if total["n"] > SAMPLE:
        raise ValueError(f"more than {SAMPLE} labelled rows; sample_of() picks so many")
    feature = np.full(BUCKETS, -1, np.int32)
    if not 0 < total["bad"] < total["n"]:
        return Severity(feature, np.zeros(1), np.arange(GRADES - 1) + 20.0)
    each = counted.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), bad).where(F.col("df") >= MIN_DF).orderBy("bucket").toArrow()
    expected = each.column("df").to_numpy() * (total["bad"] / total["n"])
    score = (each.column("bad").to_numpy() - expected) / np.sqrt(np.maximum(expected, 0.5))
    chosen = np.argsort(-score, kind="stable")[:FEATURES]
    chosen = each.column("bucket").to_numpy()[chosen[score[chosen] >= MIN_SCORE]]
    feature[chosen] = np.arange(len(chosen))
    table = counted.mapInArrow(_chosen_batches(feature), COUNTS).toArrow()
    scratch.drop(counted)
    toxic, lists = table.column("toxic").to_numpy() > 0, [table.column(c).combine_chunks() for c in ("buckets", "counts")]
    row, col, n = np.repeat(np.arange(len(toxic)), np.diff(lists[0].offsets.to_numpy())), *(x.flatten().to_numpy() for x in lists)
    x = Sparse(row, col, np.log1p(n), (len(toxic), max(1, len(chosen))))
    # grades of the toxic rows, by the number of words that go with toxicity
    many = np.bincount(row, n, len(toxic))
    cuts = np.quantile(many[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, many, side="left"), 0)
    return Severity(feature, *_maximise(x, grade))


@dataclass
class Sparse:
    """A matrix by its entries."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


def _maximise(x: Sparse, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam steps from zero weights."""
    k, (many, width) = GRADES - 1, x.shape
    share = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:k] / many, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    raw = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(raw), np.zeros_like(raw)
    rows = np.arange(many)
    for t in range(1, STEPS + 1):
        w, theta = raw[:-k], raw[-k] + np.concatenate([[0.0], np.cumsum(np.exp(raw[len(raw) - k + 1 :]))])
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - x.times(w)[:, None], -50, 50)))
        edges = np.hstack([np.zeros((many, 1)), below, np.ones((many, 1))])
        p = np.maximum(edges[rows, grade + 1] - edges[rows, grade], 1e-12)
        slope = edges * (1 - edges)
        upper, lower = slope[rows, grade + 1] / p, slope[rows, grade] / p
        d_theta = np.array([(lower[grade == j + 1].sum() - upper[grade == j].sum()) for j in range(k)]) / many
        d_w = x.turned_times(upper - lower) / many + RIDGE * w
        steps = np.exp(raw[len(raw) - k + 1 :])
        g = np.concatenate([d_w, [d_theta.sum()], [d_theta[j:].sum() * steps[j - 1] for j in range(1, k)]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        raw = raw - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return raw[:-k], raw[-k] + np.concatenate([[0.0], np.cumsum(np.exp(raw[len(raw) - k + 1 :]))])


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, one for each of the first ids in hash order.

    Labels of one id count as toxic if any says so; null ids, labels of no document and empty tables give no rows. The ids, at most
    ``rows``, are broadcast. Of several documents of one id the text of least hash is taken, so that an id in many rows counts once.
    """
    first = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def _score_batches(model: Severity, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = model.of(b.column("text"))
            any_grade = 1 - p[:, 0]
            grade = np.where(any_grade >= threshold, 1 + p[:, 1:].argmax(axis=1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in b.schema.names if c != "text"], pa.array(p @ np.arange(GRADES)), pa.array(grade), pa.array(any_grade), pa.array(any_grade >= threshold)],
                [*[c for c in b.schema.names if c != "text"], "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return run


def score(docs: DataFrame, model: Severity, *, id_col="doc_id", text_col="text", threshold: float = REJECT) -> DataFrame:
    """One row per row of docs: doc_id, expected_severity (0 to GRADES - 1), grade (0 unless toxic, else the most probable above 0), p_toxic, toxic.

    Null and empty texts have no features and get the model's base rates. Null ids and repeated rows are kept as they are.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(model, threshold), "doc_id bigint, expected_severity double, grade int, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Severity, *, threshold: float = REJECT) -> DataFrame:
    """docs, with all its columns, without the toxic documents.

    Null and empty texts have the base rates and so stay; null ids and repeated rows are judged each; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(1 - model.of(b.column("text"))[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(sample_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
