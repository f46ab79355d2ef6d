"""Ground truth from a corpus: keys of units, positive and negative pairs, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import containment_of, jaccard_of, set_jaccard
from ..operators.stats import with_position
from ..sources.scratch import Workspace

MIN_TOKENS = 30


def entities(units: DataFrame, normal=None, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(fid, file, line, ekey, rkey, tokset, ntoks) of units(fid, file, line, tokens) with enough tokens.

    ekey stands for the tokens as they are, rkey for them after ``normal`` (a column function) has taken names out.
    """
    t = F.col("tokens")
    key = lambda c: F.md5(F.array_join(c, " "))
    out = units.where(F.size("tokens") >= min_tokens)
    return out.select("fid", "file", "line", key(t).alias("ekey"), key(normal(t) if normal else t).alias("rkey"), F.array_sort(F.array_distinct(t)).alias("tokset"), F.size(t).alias("ntoks"))


def partners(ents: DataFrame, key: str) -> DataFrame:
    """(key, a, b): of each group of one key its first unit and the first of another file, else the next in place.

    Two aggregations of small structs; a very large group is combined before the shuffle.
    """
    place = F.struct("file", "line", "fid")
    first = ents.groupBy(key).agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "x")
    elsewhere = (F.col("file") != F.col("x.file")) | (F.col("line") != F.col("x.line"))
    rest = ents.select(key, "file", "line", "fid").join(first, key).where(elsewhere)
    other = rest.groupBy(key).agg(F.min(F.when(F.col("file") != F.col("x.file"), place)).alias("other"), F.min(place).alias("near"), F.first("x.fid").alias("a"))
    return other.select(key, "a", F.coalesce("other", "near")["fid"].alias("b"))


def evolved(rows: DataFrame, keys: list[str], version: str, content: str) -> DataFrame:
    """(keys, a, b): each version with the next of the same thing, where the content differs."""
    by = W.partitionBy(*keys).orderBy(version, content)
    out = rows.withColumn("b", F.lead(version).over(by)).withColumn("_next", F.lead(content).over(by))
    return out.where(F.col("b").isNotNull() & (F.col(content) != F.col("_next"))).withColumnRenamed(version, "a")


def random_negatives(ents: DataFrame, n: int, work: Workspace | None = None) -> DataFrame:
    """n pairs of neighbours in hash order that differ in rkey, are of like size and share few tokens."""
    at = with_position(ents.withColumn("_h", F.md5(F.col("fid").cast("string"))), ["_h", "fid"], work)
    x = at.select(F.col("fid").alias("a"), F.col("rkey").alias("r"), F.col("tokset").alias("s"), F.col("ntoks").alias("m"), F.col("_at").alias("k"))
    y = at.select(F.col("fid").alias("b"), F.col("rkey").alias("q"), F.col("tokset").alias("t"), F.col("ntoks").alias("n"), (F.col("_at") - 1).alias("k"))
    like = (F.col("r") != F.col("q")) & (F.least("m", "n") * 2 >= F.greatest("m", "n")) & (set_jaccard(F.col("s"), F.col("t")) < 0.3)
    return x.join(y, "k").where(like).orderBy("k").limit(n).select("a", "b")


def same_file_negatives(ents: DataFrame) -> DataFrame:
    """Of each file its first unit and the first later one that differs in rkey and shares few tokens."""
    first = ents.groupBy("file").agg(F.min_by(F.struct("line", "fid", "rkey", "tokset"), F.struct("line", "fid")).alias("x"))
    rest = ents.join(first, "file").where((F.col("line") > F.col("x.line")) & (F.col("rkey") != F.col("x.rkey")) & (set_jaccard(F.col("tokset"), F.col("x.tokset")) < 0.35))
    return rest.groupBy("file").agg(F.first("x.fid").alias("a"), F.min_by("fid", F.struct("line", "fid")).alias("b"))


def score_given(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with exact j and c; pairs that share nothing score 0."""
    wanted = pairs.select("a", "b").distinct()
    x, y = features.select(F.col("fid").alias("a"), "h", F.col("w").alias("x")), features.select(F.col("fid").alias("b"), "h", F.col("w").alias("y"))
    shared = wanted.join(x, "a").join(y, ["b", "h"]).groupBy("a", "b").agg(F.sum(F.least("x", "y")).cast("bigint").alias("s"))
    total = features.groupBy("fid").agg(F.sum("w").cast("bigint").alias("t"))
    out = pairs.join(shared, ["a", "b"], "left").join(total.select(F.col("fid").alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col("fid").alias("b"), F.col("t").alias("tb")), "b")
    s = F.coalesce("s", F.lit(0))
    return out.withColumn("j", jaccard_of(s, F.col("ta"), F.col("tb"))).withColumn("c", F.greatest(containment_of(s, F.col("ta")), containment_of(s, F.col("tb")))).drop("s", "ta", "tb")
