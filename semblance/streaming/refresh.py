"""An index that follows saved files, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.corpus import index_of
from ..plans.index import Index, load
from ..sources.files import extract_units

SAVES = "path string, content binary, saved timestamp"


def latest(saves: DataFrame) -> DataFrame:
    """The last save of each path in a batch."""
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("saved"), F.desc(F.md5("content"))))
    return saves.withColumn("_k", rank).where("_k = 1").drop("_k")


def refresh_on_save(saves: DataFrame, path: str, checkpoint: str, profile: str = "structural", on_snapshot: Callable[[Index, DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """For each batch of saves (SAVES) writes a new snapshot at ``path`` in which those files' units are replaced.

    Batches are numbered. One that runs again after a failure starts from the version before its own and writes that
    anew, in another folder; readers follow the pointer to the newest. on_snapshot gets the new index and the batch's fresh units, to diagnose them.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch).persist()
        try:
            if fresh.isEmpty():
                return
            units = extract_units(fresh.select("path", "content"), profile)
            new, old = index_of(units), load(spark, path, without=f"batch-{number}")
            gone = old.units.join(fresh.select(F.col("path").alias("file")), "file", "left_anti")
            kept = old.features.join(gone.select("fid"), "fid", "left_semi")
            index = Index(gone.select(old.units.columns), kept.select(old.features.columns)).append(new.units, new.features)
            index = index.snapshot(path, f"batch-{number}")
            if on_snapshot:
                on_snapshot(index, new.units)
        finally:
            fresh.unpersist()

    return saves.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def saved_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that arrive or change below a path, as saves."""
    df = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(path)
    return df.select("path", "content", F.col("modificationTime").alias("saved"))
