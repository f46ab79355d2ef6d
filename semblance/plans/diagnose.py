"""What a look at single functions needs: differences, duplicates of fresh units, parse statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frontend import Graph, graph_of, unique_nodes
from ..functions.text import share
from .index import Index


def diff(a: Graph, b: Graph) -> dict:
    """Scores of two functions, and by line what each has alone."""
    fa, fb = (dict.fromkeys(h for h, _ in g.features()) for g in (a, b))
    both = len(fa.keys() & fb.keys())
    lines = lambda nodes: {n: sorted({x for m, x in nodes if m == n}) for n in sorted({m for m, _ in nodes})}
    total = len(fa.keys() | fb.keys())
    return {"jaccard": both / total if total else 0.0, "a_in_b": both / len(fa) if fa else 0.0, "b_in_a": both / len(fb) if fb else 0.0, "only_a": lines(unique_nodes(a, b)), "only_b": lines(unique_nodes(b, a))}


def diff_sources(a: tuple[str, str], b: tuple[str, str], **pick) -> dict:
    """Of two (path, text), with a_name, a_line, b_name, b_line to pick the function."""
    return diff(graph_of(*a, pick.get("a_name"), pick.get("a_line")), graph_of(*b, pick.get("b_name"), pick.get("b_line")))


def diagnostics(index: Index, fresh: DataFrame, threshold: float = 0.7, min_features: int = 15) -> DataFrame:
    """For fresh units their best other match of at least min_features features on both sides, if it reaches the threshold."""
    from ..operators.search import QueryFilter, nests

    size = index.features.groupBy("fid").agg(F.count(F.lit(1)).alias("n_query"))
    mine = index.features.join(fresh.select("fid"), "fid", "left_semi").withColumnRenamed("fid", "qid")
    hits = index.search(mine, QueryFilter(threshold=threshold, min_features=min_features, limit=0)).where("qid <> fid")
    q = index.units.select([F.col(c).alias("qid" if c == "fid" else f"q_{c}") for c in index.units.columns])
    hits = hits.join(q, "qid").join(size.withColumnRenamed("fid", "qid"), "qid").where(F.col("n_query") >= min_features).where(~nests("q_", ""))
    best = F.struct(F.greatest("jaccard", "containment"), "jaccard", -F.col("fid"))
    return hits.groupBy("qid", "q_name", "q_file", "q_line_start").agg(F.max_by(F.struct("fid", "name", "file", "line_start", "jaccard", "containment"), best).alias("match"))


def only_in(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, line, labels): by line, the labels of the emitting nodes of unit a none of whose hashes, of any level, is one of unit b.

    nodes as extract_nodes() gives them; all pairs (a, b) at once, by two joins and an aggregation for each node.
    """
    emitted = nodes.where("emit")
    mine = pairs.select("a", "b").distinct().join(emitted.select(F.col("fid").alias("a"), "idx", "line", "label", F.explode("rounds").alias("h")), "a")
    theirs = pairs.select("a", "b").distinct().join(emitted.select(F.col("fid").alias("b"), F.explode("rounds").alias("h")), "b").select("a", "b", "h").distinct().withColumn("hit", F.lit(True))
    alone = mine.join(theirs, ["a", "b", "h"], "left").groupBy("a", "b", "idx", "line", "label").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit")).where("not hit")
    return alone.groupBy("a", "b", "line").agg(F.array_sort(F.collect_set("label")).alias("labels"))


#: Share of unknown nodes from which a unit is badly read.
BAD_SHARE = 0.25


def parse_stats(units: DataFrame) -> DataFrame:
    """By language: files, files that failed, units, code lines, nodes; units without, with some and with many unknown expressions; unknown ones a hundred nodes; mean features."""
    bad = F.col("error").isNotNull()
    lang = F.coalesce("lang", F.concat(F.lit("?"), F.regexp_extract("file", r"(\.[^./]+)$", 1)))
    part = share(F.coalesce("unknown", F.lit(0)).cast("double"), F.coalesce("nodes", F.lit(0)).cast("double"))
    return units.groupBy(lang.alias("lang")).agg(
        F.count_distinct("file").alias("files"), F.count_distinct(F.when(bad, F.col("file"))).alias("failed"), F.count_if(~bad).alias("units"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"),
        F.count_if(~bad & (part == 0)).alias("clean"), F.count_if(~bad & (part > 0) & (part < BAD_SHARE)).alias("some_unknown"), F.count_if(~bad & (part >= BAD_SHARE)).alias("many_unknown"),
        share(100.0 * F.coalesce(F.sum("unknown"), F.lit(0)), F.coalesce(F.sum("nodes"), F.lit(0)).cast("double")).alias("unknown_pct"),
        share(F.sum(F.size(F.coalesce("features", F.array().cast("array<struct<h:bigint,w:int,tag:string>>")))).cast("double"), F.count_if(~bad)).alias("mean_features"),
    )


def worst_files(units: DataFrame, n: int = 10) -> DataFrame:
    """The n files with the most units that failed or hold unknown expressions; ties by file."""
    bad = F.count_if(F.col("error").isNotNull() | (F.coalesce("unknown", F.lit(0)) > 0))
    return units.groupBy("file").agg(bad.alias("bad"), F.count(F.lit(1)).alias("units")).where("bad > 0").orderBy(F.desc("bad"), "file").limit(n)
