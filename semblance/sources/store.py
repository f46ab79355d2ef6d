"""Stored signatures of dependencies, and the tab-separated files of pairs and scores."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..frontend.signature import EDGES, MISC, PROFILES, SHAPE, TAG_WEIGHTS, Options
from ..operators.stats import stratified

FORMAT = 2
PAIRS = "label string, kind string, fa string, la int, la_end int, na string, fb string, lb int, lb_end int, nb string"
JUDGED = "label string, kind string, fa string, la int, na string, fb string, lb int, nb string, jaccard double, containment double"
SCORES = "fa string, la int, fb string, lb int, j double, c double"


def config_tag(profile: str, options: Options | None = None) -> str:
    """A short digest of everything that a signature depends on: profile, weights, bucket edges and the channels of every language."""
    from ..frontend.dataflow import BASE

    options = options or Options()
    langs = {k: asdict(options.channels(k)) for k in sorted([*BASE, ""])}
    said = json.dumps([FORMAT, profile, PROFILES[profile], TAG_WEIGHTS | (options.weights or {}), MISC, SHAPE, EDGES, langs], sort_keys=True)
    return f"{profile}-{hashlib.sha256(said.encode()).hexdigest()[:12]}"


class SigStore:
    """Units with features by (package, version, configuration), as partitions of one Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, units: DataFrame, package: str, version: str, tag: str) -> None:
        """Replaces this partition and leaves the others."""
        rows = units.withColumns({"package": F.lit(package), "version": F.lit(version), "tag": F.lit(tag)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package", "version", "tag").parquet(self.path)

    def load(self, package: str, version: str, tag: str) -> DataFrame | None:
        """The units, or None if this version was never stored under this configuration."""
        try:
            table = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/package={package}/version={version}/tag={tag}")
        except AnalysisException:
            return None
        return table.drop("package", "version", "tag")

    def load_or(self, package: str, version: str, tag: str, make) -> DataFrame:
        found = self.load(package, version, tag)
        if found is None:
            self.save(make(), package, version, tag)
            found = self.load(package, version, tag)
        return found


def write_tsv(df: DataFrame, path: str, schema: str) -> None:
    """Columns of the schema, without header; scores with four decimals."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = dict(df.dtypes)
    df.select([F.format_string("%.4f", F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in names]).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with exactly the schema's columns; others are dropped."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("x")).where(F.size("x") == len(names))
    out = rows.select([F.expr(f"try_cast(x[{k}] as {kind})").alias(n) for k, (n, kind) in enumerate(names)])
    return out.where(F.col(names[1][0]).isNotNull())


def eval_pairs(pairs: DataFrame, units: DataFrame, features: DataFrame) -> tuple[DataFrame, int]:
    """pairs (TSV columns) with j and c of the units that start at their places, and how many pairs found no unit.

    If several units start at one place, the last by fid counts.
    """
    from ..plans.mining import score_given

    at = units.groupBy("file", "line_start").agg(F.max("fid").alias("fid"))
    one = at.select(F.col("file").alias("fa"), F.col("line_start").alias("la"), F.col("fid").alias("a"))
    two = at.select(F.col("file").alias("fb"), F.col("line_start").alias("lb"), F.col("fid").alias("b"))
    found = pairs.join(one, ["fa", "la"], "left").join(two, ["fb", "lb"], "left")
    skipped = found.where("a is null or b is null").count()
    return score_given(found.where("a is not null and b is not null"), features), skipped


def judge_rows(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """The pairs (TSV columns) with their scores (TSV columns) by place; pairs without a score have null ones."""
    s = scores.select("fa", "la", "fb", "lb", F.col("j").alias("jaccard"), F.col("c").alias("containment"))
    return pairs.join(s.dropDuplicates(["fa", "la", "fb", "lb"]), ["fa", "la", "fb", "lb"], "left").select("label", "kind", "fa", "la", "na", "fb", "lb", "nb", "jaccard", "containment")


def judge_sample(pairs: DataFrame, scores: DataFrame, quota: int) -> DataFrame:
    """Scored pairs for a judge to look at: of each kind the most surprising (a low score of a positive, a high one of a negative) and some at random."""
    rows = judge_rows(pairs, scores).where("jaccard is not null").withColumn("place", F.concat_ws(":", "fa", "la", "fb", "lb"))
    surprise = F.when(F.col("label") == "pos", 1 - F.col("jaccard")).otherwise(F.col("jaccard"))
    return stratified(rows, "kind", quota, surprise, "place").drop("place")
