"""Weighted similarity of feature sets. Weights are integers (tenths), so sums don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import share


def jaccard_of(shared: Column, wa: Column, wb: Column) -> Column:
    """Sum of minima over sum of maxima, from the sum of minima and both totals; 0 of nothing."""
    return share(shared.cast("double"), (wa + wb - shared).cast("double"))


def containment_of(shared: Column, wq: Column) -> Column:
    """Share of the query's weight that the other has; 0 of nothing."""
    return share(shared.cast("double"), wq.cast("double"))


def _shared(a: Column, b: Column) -> Column:
    """Sum of minima of two arrays of (h, w) with distinct h."""
    m = F.map_from_entries(b)
    return F.aggregate(F.transform(a, lambda x: F.least(x["w"], F.coalesce(F.try_element_at(m, x["h"]), F.lit(0))).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["w"])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two signatures held as arrays of (h, w)."""
    return jaccard_of(_shared(a, b), _total(a), _total(b))


def containment(q: Column, t: Column) -> Column:
    """Of the query signature q in t."""
    return containment_of(_shared(q, t), _total(q))


def set_jaccard(a: Column, b: Column) -> Column:
    """Unweighted, of two arrays; 0 if both are empty."""
    return share(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


SIGNATURE = "array<struct<h: bigint, w: int>>"


def register(spark: SparkSession) -> None:
    """weighted_jaccard(a, b) and containment(q, t) of signatures, and set_jaccard(a, b) of arrays of strings, as functions in SQL of this session."""
    total = lambda x: f"aggregate({x}, bigint(0), (s, x) -> s + x.w)"
    both = "aggregate(transform(a, x -> least(x.w, coalesce(try_element_at(map_from_entries(b), x.h), 0))), bigint(0), (s, x) -> s + x)"
    body = {
        ("weighted_jaccard", SIGNATURE): f"coalesce(try_divide(double({both}), double({total('a')} + {total('b')} - {both})), double(0))",
        ("containment", SIGNATURE): f"coalesce(try_divide(double({both}), double({total('a')})), double(0))",
        ("set_jaccard", "array<string>"): "coalesce(try_divide(double(size(array_intersect(a, b))), double(size(array_union(a, b)))), double(0))",
    }
    for (name, kind), expression in body.items():
        spark.sql(f"create or replace temporary function {name}(a {kind}, b {kind}) returns double return {expression}")
