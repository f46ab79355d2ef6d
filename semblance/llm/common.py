"""What the corpus operators share: the shared folder, stored intermediates, word rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between words, as a string for translate().
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process may it be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="semblance-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is the user's to clear then
        pass


class Scratch:
    """Written tables that cut lineage. A table survives the loss of any executor.

    ``keep(df)`` writes df as Parquet under the shared folder and returns what reads it;
    ``drop(df)`` deletes one that no later plan reads; the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/semblance/{name}-{uuid.uuid4().hex}"
        self.written, self.kept = 0, []
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes what keep() returned; the frame is held until then, so none is taken for another."""
        for df in dfs:
            (path,) = (p for kept, p in self.kept if kept is df)
            self.kept = [x for x in self.kept if x[0] is not df]
            _delete(self.spark, path)


#: Rows of a batch that are worked on at once.
ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows, so that what a task holds for each row stays small whatever the session's batch size.

    At the end a worker, which waits for the next task, gives back the memory that Arrow keeps.
    """
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)
    pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """The words of a text; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
