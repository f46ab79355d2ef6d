"""The index: units and features, kept as versioned tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import df_cutoff
from ..operators.pairs import scored_hits, scored_pairs
from ..operators.search import PairFilter, QueryFilter, nests, top_hits, top_pairs
from ..operators.setops import replace_file
from ..sources.scratch import Workspace

UNIT_COLUMNS = "fid bigint, name string, file string, lang string, line_start int, line_end int, code_lines int, origin string"
FEATURE_COLUMNS = "fid bigint, h bigint, w int"
POINTER = "version string, at string, n_units bigint"


@dataclass
class Index:
    """units (fid, name, file, line_start, line_end, code_lines, origin, ...) and their features (fid, h, w)."""

    units: DataFrame
    features: DataFrame
    n_units: int | None = None
    work: Workspace | None = None
    #: (fid, text) where the features are the shingles of texts: pairs then make them where they need them
    texts: DataFrame | None = None
    #: (fid, h, w) with arrays of features, where units were extracted with them: pairs then read these, without a row for each feature
    lists: DataFrame | None = None

    @property
    def cutoff(self) -> int:
        """Fixed by all units, whatever a search filters."""
        if self.n_units is None:
            self.n_units = self.units.count()
        return df_cutoff(self.n_units)

    def append(self, units: DataFrame, features: DataFrame) -> Index:
        return Index(self.units.unionByName(units.select(self.units.columns)), self.features.unionByName(features.select(self.features.columns)))

    def refresh(self, units: DataFrame, features: DataFrame) -> Index:
        """With the units of some files replaced by fresh ones; fresh fids must be new or those replaced."""
        gone = self.units.join(units.select("file").distinct(), "file", "left_semi").select("fid")
        kept = self.features.join(gone, "fid", "left_anti")
        return Index(replace_file(self.units, units), kept.select(self.features.columns).unionByName(features.select(self.features.columns)))

    def count(self) -> int:
        return self.units.count()

    def written(self, work: Workspace) -> Index:
        """The same, read from tables in a workspace: what comes after does not carry the steps that led here."""
        return Index(work.keep(self.units), work.keep(self.features), self.n_units, work)

    def snapshot(self, path: str, version: str) -> Index:
        """Writes a version, then a pointer to it beside the older ones; readers take the last that is complete, so they see the old version or the new one.

        Nothing is overwritten: a version written again (by a batch that runs twice, say) has a folder of its own.
        """
        spark = self.units.sparkSession
        at = f"data/{version}-{uuid.uuid4().hex[:12]}"
        self.units.write.parquet(f"{path}/{at}/units")
        # by hash, so that a later probe by hash reads sorted files
        self.features.repartition("h").sortWithinPartitions("h").write.parquet(f"{path}/{at}/features")
        n_units = spark.read.parquet(f"{path}/{at}/units").count()
        last = max((int(x.split("-")[0]) for x in _pointers(spark, path)), default=-1)
        spark.createDataFrame([(version, at, n_units)], POINTER).coalesce(1).write.parquet(f"{path}/versions/{last + 1:010d}-{uuid.uuid4().hex[:8]}")
        return load(spark, path)

    def search(self, queries: DataFrame, flt: QueryFilter | None = None) -> DataFrame:
        """Hits of query features (qid, h, w), best first, at most the filter's limit for each query."""
        flt = flt or QueryFilter()
        hits = scored_hits(queries, self.features, cutoff=self.cutoff, work=self.work).join(self.units, "fid").where(flt.passes())
        return top_hits(hits, flt.limit)

    def duplicates(self, flt: PairFilter | None = None, nested: bool = False, sort: bool = True) -> DataFrame:
        """Pairs of the whole index, the best first; one unit inside the other counts only with nested. Without ``sort``, and without a limit, in any order."""
        flt = flt or PairFilter()
        among = None
        if flt.origin_a is not None and flt.origin_b is not None:
            # units of other origins are in no pair that passes; frequencies and cutoff stay those of all
            among = self.units.where(F.col("origin").isin(flt.origin_a, flt.origin_b)).select("fid")
        pairs = scored_pairs(self.features if self.lists is None else self.lists, threshold=flt.threshold, metric=flt.metric, cutoff=self.cutoff, work=self.work, among=among, texts=self.texts)
        for side in ("a", "b"):
            pairs = pairs.join(self.units.select([F.col(c).alias(side if c == "fid" else f"{side}_{c}") for c in self.units.columns]), side)
        pairs = pairs.where(flt.passes())
        if not nested and {"line_start", "line_end"} <= set(self.units.columns):
            pairs = pairs.where(~F.coalesce(nests("a_", "b_"), F.lit(False)))
        return top_pairs(pairs, flt.limit) if sort or flt.limit > 0 else pairs


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete pointers, the oldest first."""
    at, fs = _files(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    done = [x.getPath() for x in fs.listStatus(at)]
    jvm = spark.sparkContext._jvm
    return sorted(p.getName() for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load(spark: SparkSession, path: str, without: str | None = None) -> Index:
    """The newest version, or the newest that isn't ``without``."""
    for name in reversed(_pointers(spark, path)):
        now = spark.read.schema(POINTER).parquet(f"{path}/versions/{name}").first()
        if now["version"] != without:
            return Index(spark.read.parquet(f"{path}/{now['at']}/units"), spark.read.parquet(f"{path}/{now['at']}/features"), now["n_units"])
    raise LookupError(f"no version of an index at {path}")


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last versions. Readers of an older one must have ended."""
    for name in _pointers(spark, path)[:-keep]:
        now = spark.read.schema(POINTER).parquet(f"{path}/versions/{name}").first()
        for gone in (f"{path}/versions/{name}", f"{path}/{now['at']}"):
            at, fs = _files(spark, gone)
            fs.delete(at, True)
