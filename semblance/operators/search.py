"""Filters, top-k and nesting on scored rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_nocase


def path_passes(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Any include (or none given) and no exclude."""
    include, exclude = list(include), list(exclude)
    some = reduce(or_, [contains_nocase(path, x) for x in include]) if include else F.lit(True)
    return reduce(and_, [~contains_nocase(path, x) for x in exclude], some)


def nests(a: str, b: str) -> Column:
    """Whether one of two units (by column prefix) contains the other: same file, one range inside the other."""
    s, e, t, u = F.col(f"{a}line_start"), F.col(f"{a}line_end"), F.col(f"{b}line_start"), F.col(f"{b}line_end")
    return (F.col(f"{a}file") == F.col(f"{b}file")) & (((s <= t) & (e >= u)) | ((t <= s) & (u >= e)))


@dataclass(frozen=True)
class QueryFilter:
    """What a hit must meet; limit 0 keeps all."""

    threshold: float = 0.25
    min_lines: int = 0
    min_features: int = 0
    name: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    origin: str | None = None
    limit: int = 5

    def passes(self) -> Column:
        out = F.greatest("jaccard", "containment") >= self.threshold
        out &= (F.col("code_lines") >= self.min_lines) & (F.col("n_feat") >= self.min_features) & contains_nocase(F.col("name"), self.name) & path_passes(F.col("file"), self.include, self.exclude)
        return out if self.origin is None else out & (F.col("origin") == self.origin)


@dataclass(frozen=True)
class PairFilter:
    """What a pair must meet: sizes on the smaller side, the name on either side, the path on both; limit 0 keeps all."""

    threshold: float = 0.5
    metric: str = "jaccard"
    min_lines: int = 0
    min_features: int = 0
    name: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    origin_a: str | None = None
    origin_b: str | None = None
    limit: int = 0

    def passes(self) -> Column:
        out = (F.least("a_code_lines", "b_code_lines") >= self.min_lines) & (F.least("a_features", "b_features") >= self.min_features)
        out &= contains_nocase(F.col("a_name"), self.name) | contains_nocase(F.col("b_name"), self.name)
        out &= path_passes(F.col("a_file"), self.include, self.exclude) & path_passes(F.col("b_file"), self.include, self.exclude)
        one = lambda x, o: F.lit(True) if o is None else F.col(f"{x}_origin") == o
        # scope is unordered: either side may be the one in scope a
        return out & ((one("a", self.origin_a) & one("b", self.origin_b)) | (one("b", self.origin_a) & one("a", self.origin_b)))



def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best per query by max(jaccard, containment), then jaccard, then fid, with rank."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.greatest("jaccard", "containment")), F.desc("jaccard"), "fid"))
    out = hits.withColumn("rank", rank)
    return out.where(F.col("rank") <= k) if k > 0 else out


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The n best by j, ties to smaller ids; all if n is 0 or less."""
    out = pairs.orderBy(F.desc("j"), "a", "b")
    return out.limit(n) if n > 0 else out


def competition_rank(hits: DataFrame) -> DataFrame:
    """1 + the number of strictly better hits of the same query."""
    return hits.withColumn("rank", F.rank().over(W.partitionBy("qid").orderBy(F.desc(F.greatest("jaccard", "containment")), F.desc("jaccard"))))


def rank_of(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, fid, rank) of the targets (qid, fid) that are hits: 1 + the number of strictly better hits, counted, so that no query's hits are sorted."""
    met = hits.join(targets.select("qid", "fid").distinct(), ["qid", "fid"]).select("qid", F.col("fid").alias("t_fid"), F.col("jaccard").alias("t_jaccard"), F.col("containment").alias("t_containment"))
    both = hits.select("qid", "jaccard", "containment").join(met, "qid")
    best, t_best = F.greatest("jaccard", "containment"), F.greatest("t_jaccard", "t_containment")
    better = F.count_if((best > t_best) | ((best == t_best) & (F.col("jaccard") > F.col("t_jaccard"))))
    return both.groupBy("qid", F.col("t_fid").alias("fid")).agg((better + 1).cast("int").alias("rank"))


def narrowest_at(units: DataFrame, points: DataFrame) -> DataFrame:
    """For points (pid, file, line) the narrowest named unit over the line, else the narrowest lambda."""
    inside = points.join(units, "file").where("line between line_start and line_end")
    lam = F.col("name").endswith("<lambda>")
    rank = F.row_number().over(W.partitionBy("pid").orderBy(lam, F.col("line_end") - F.col("line_start"), "fid"))
    return inside.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_by_name(units: DataFrame, name: str) -> DataFrame:
    """The first unit of a name in file order, else the first unit."""
    return units.orderBy(F.col("name") != name, "file", "line_start", "fid").limit(1)
