"""Set operations on features and units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of a(pid, h) that b(pid, h) lacks, pair by pair."""
    return a.join(b.select("pid", "h").distinct(), ["pid", "h"], "left_anti")


def unordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) once each, the smaller id first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def replace_file(units: DataFrame, fresh: DataFrame, key: str = "file") -> DataFrame:
    """units without those of the files that fresh has, and fresh."""
    return units.join(fresh.select(key).distinct(), key, "left_anti").select(units.columns).unionByName(fresh.select(units.columns))
