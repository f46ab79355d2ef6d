"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="semblance-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores if it comes in fewer partitions (one file of one row group, say); a large one stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class Workspace:
    """Tables that several parts of a plan read: computed once, kept through the loss of executors, gone when Python ends."""

    def __init__(self, spark: SparkSession, tidies: bool = True):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/semblance/work-{uuid.uuid4().hex}", 0
        self.paths, self.tidies = {}, tidies
        atexit.register(self.clear)

    def keep(self, df: DataFrame, alone: bool = False, rows: int | None = None) -> DataFrame:
        """With ``alone`` each row has a file, so that large rows are read one by one, and arrays of bytes are stored as they are. With ``rows`` Python gets so many at a time."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.options(maxRecordsPerFile=1, compression="none", **{"parquet.enable.dictionary": "false"}) if alone else df.write
        conf, at_a_time = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(at_a_time)
        conf.set(at_a_time, str(rows or before))
        try:
            writer.parquet(path)
        finally:
            conf.set(at_a_time, before)
        # vectored reads hold on to memory outside the heap
        kept = self.spark.read.option("parquet.hadoop.vectored.io.enabled", "false").schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Deletes a table of this workspace that nothing reads any more."""
        self._delete(self.paths.pop(id(kept)))

    def tidy(self) -> None:
        """Lets go of shuffled files that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
        for _ in range(2 * self.tidies):  # references go from Python first, then from the JVM, then the files
            gc.collect()
            time.sleep(0.3)
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.7)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended first
            return

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
