"""Sampling, percentiles, rank correlation and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Workspace

def even_sample(df: DataFrame, n: int, order, work: Workspace | None = None) -> DataFrame:
    """n rows at even steps of the order: positions floor(i * rows / n). All rows if there are no more than n.

    Positions come from the sizes of ordered partitions, so no task sees all rows.
    """
    numbered = with_position(df, order, work)
    total = numbered.count()
    if total <= n or n <= 0:
        return numbered.drop("_at")
    i = F.ceil(F.col("_at") * n / total)
    return numbered.where((i < n) & (F.floor(i * total / n) == F.col("_at"))).drop("_at")


def with_position(df: DataFrame, order, work: Workspace | None = None) -> DataFrame:
    """Adds _at: the place of each row in the order (columns that order totally), from 0."""
    return with_running(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", work).withColumn("_at", F.col("_upto") - 1).drop("_one", "_upto")


def with_running(df: DataFrame, order, amount: str, work: Workspace | None = None) -> DataFrame:
    """Adds _upto: the sum of an amount over the rows up to each one in the order, by range partitions and their sums.

    The dealt rows are written once: their bounds are sampled, so a second run could deal them out otherwise.
    """
    order = order if isinstance(order, (list, tuple)) else [order]
    work = work or Workspace(df.sparkSession)
    dealt = work.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # a row for each partition
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = dealt.withColumn("_k", F.sum(amount).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return inside.join(sums.withColumn("_before", before), "_part").withColumn("_upto", F.col("_before") + F.col("_k")).drop("_part", "_k", "_n", "_before")


def nearest_rank(values: Column, p: float) -> Column:
    """The p-quantile of an array by nearest rank: sorted[int(p * (n - 1) + 0.5)]."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.get(s, F.least(n - 1, F.floor(F.lit(p) * (n - 1) + 0.5).cast("int")))


def percentiles(df: DataFrame, group: str, value: str, ps=(0.1, 0.5, 0.9)) -> DataFrame:
    """Nearest-rank percentiles of value by group, from counts of distinct values, so large groups stay small."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(group)
    last = F.sum("n").over(by.orderBy(value))
    total = F.sum("n").over(by)
    out = counts.withColumn("last", last).withColumn("total", total)
    at = lambda p: F.least(F.col("total") - 1, F.floor(F.lit(p) * (F.col("total") - 1) + 0.5))
    hit = lambda p: F.max(F.when((F.col("last") > at(p)) & (F.col("last") - F.col("n") <= at(p)), F.col(value))).alias(f"p{round(100 * p)}")
    return out.groupBy(group).agg(*[hit(p) for p in ps])


def spearman(df: DataFrame, x: str, y: str, work: Workspace | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties, from counts of distinct values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))

    def ranks(c: str) -> DataFrame:
        counts = with_running(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, "n", work)
        return counts.select(c, (F.col("_upto") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))

    both = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")).join(ranks("x"), "x").join(ranks("y"), "y")
    s = both.agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rx")).alias("sx"), F.sum(F.col("m") * F.col("ry")).alias("sy"), F.sum(F.col("m") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("m") * F.col("ry") * F.col("ry")).alias("syy"), F.sum(F.col("m") * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    n = F.col("n")
    below = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select(n.alias("n"), F.when(below > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / below).otherwise(0.0).alias("rho"))


def rates(df: DataFrame, *keys: str) -> DataFrame:
    """By keys, of scored pairs (j, c): number, means and shares over the usual thresholds."""
    over = lambda c, t: F.avg((c >= t).cast("int"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("j").alias("mean_j"), over(F.col("j"), 0.5).alias("j50"), over(F.col("j"), 0.7).alias("j70"), over(F.greatest("j", "c"), 0.5).alias("max50"))


def retrieval(ranks: DataFrame) -> DataFrame:
    """By kind and for ALL, of ranks (kind, rank; 0: not found): MRR, recall at 1, 5, 10 and misses."""
    found = F.col("rank") > 0
    part = lambda k: F.avg((found & (F.col("rank") <= k)).cast("int"))
    out = ranks.rollup("kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(found, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"), part(1).alias("r1"), part(5).alias("r5"), part(10).alias("r10"), F.avg((~found).cast("int")).alias("miss"), F.grouping("kind").alias("g")
    )
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("kind")).alias("kind"), "n", "mrr", "r1", "r5", "r10", "miss")


def stratified(df: DataFrame, kind: str, quota: int, surprise, key: str) -> DataFrame:
    """Of each kind at most ``quota`` rows: half of them the most surprising ones, the rest the first of the others in hash order of ``key``.

    A kind with fewer rows is taken whole. Ties in surprise go by the hash.
    """
    h = F.md5(F.col(key).cast("string"))
    top = F.row_number().over(W.partitionBy(kind).orderBy(F.desc("_s"), "_h", key))
    rows = df.withColumn("_s", surprise).withColumn("_h", h).withColumn("_top", top).withColumn("_first", F.col("_top") <= quota // 2)
    rest = F.row_number().over(W.partitionBy(kind, "_first").orderBy("_h", key))
    return rows.withColumn("_rest", rest).where(F.col("_first") | (F.col("_rest") <= quota - quota // 2)).drop("_s", "_h", "_top", "_first", "_rest")
