"""From paths to an index: the workspace, and its dependencies through the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frontend.signature import Options
from ..sources.deps import packages_of
from ..sources.files import extract_units, local_files, read_sources, unit_features
from ..sources.store import SigStore, config_tag
from .index import Index

MIN_FEATURES = 5


def index_of(units: DataFrame, min_features: int = MIN_FEATURES) -> Index:
    """An index of extracted units; rows with an error, or with too few features, are left out."""
    ok = units.where(F.col("error").isNull() & (F.size("features") >= min_features))
    keep = ["fid", "name", "file", "lang", "line_start", "line_end", "code_lines", "origin"]
    return Index(ok.select(keep), unit_features(ok), lists=ok.select("fid", F.col("features.h").alias("h"), F.col("features.w").alias("w")))


def workspace(spark: SparkSession, paths: list[str], profile: str = "structural", options: Options | None = None) -> DataFrame:
    return extract_units(read_sources(spark, paths), profile, options=options)


def dependencies(spark: SparkSession, roots: list[str], store: str, profile: str = "structural", options: Options | None = None) -> DataFrame | None:
    """Units of the dependencies of some projects, None without any; a version of a package is extracted once for a configuration."""
    out, kept, tag = None, SigStore(spark, store), config_tag(profile, options)
    for p in sorted({p for r in roots for p in packages_of(r)}):
        deps = kept.load_or(p.name, p.version, tag, lambda p=p: extract_units(local_files(spark, [p.path]), profile, origin="deps", options=options))
        out = deps if out is None else out.unionByName(deps.select(out.columns))
    return out


def with_dependencies(spark: SparkSession, roots: list[str], store: str, profile: str = "structural", options: Options | None = None) -> DataFrame:
    """Units of the workspace and of its dependencies."""
    out, deps = workspace(spark, roots, profile, options), dependencies(spark, roots, store, profile, options)
    return out if deps is None else out.unionByName(deps.select(out.columns))
