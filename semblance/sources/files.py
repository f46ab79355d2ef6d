"""Source files as a table, and units cut out of them."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frontend.signature import Options

# The extensions taken as source code, the directories left out and the size limit.
EXTENSIONS = (".rs", ".py", ".js", ".ts", ".go", ".java", ".c", ".h", ".cc", ".cpp", ".cxx", ".cppm", ".hpp", ".hh", ".hxx", ".ml", ".mli")
SKIPPED = {"target", "_build", "node_modules", "dist", "__pycache__"}
MAX_BYTES = 600 * 1024

UNITS = "name string, file string, lang string, line_start int, line_end int, code_lines int, tokens array<string>, features array<struct<h: bigint, w: int, tag: string>>, nodes int, unknown int, error string"
NODES = "name string, file string, line_start int, line_end int, idx int, line int, label string, tag string, emit boolean, commutative boolean, preds array<struct<idx: int, pos: int>>, rounds array<bigint>"


def list_sources(paths: Iterable[str]) -> list[str]:
    """Files below some local paths, sorted in each directory; symbolic links, dot entries and SKIPPED are left out, unreadable entries too."""
    out: list[str] = []

    def walk(path: str) -> None:
        try:
            if os.path.isfile(path):
                if os.path.splitext(path)[1] in EXTENSIONS and os.path.getsize(path) <= MAX_BYTES:
                    out.append(path)
                return
            for name in sorted(os.listdir(path)):
                full = os.path.join(path, name)
                if not name.startswith(".") and name not in SKIPPED and not os.path.islink(full):
                    walk(full)
        except OSError:
            return

    for p in paths:
        walk(os.path.realpath(p))
    return out


def source_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, modificationTime, content) below shared paths, listed and read by Spark; both limits go to the source."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: x.startswith(".") | x.isin(*sorted(SKIPPED)))
    return df.where((F.col("length") <= MAX_BYTES) & F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*EXTENSIONS) & ~hidden)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            try:
                with open(path, "rb") as f:
                    content = f.read()
            except OSError:  # gone since it was listed
                continue
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])


#: Listed files that a task reads.
FILES_IN_TASK = 64


def local_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, content) of files below local paths: the driver lists them, tasks read them, which must see the same disk."""
    found = list_sources(paths)
    listed = spark.createDataFrame([(p,) for p in found], "path string")
    return listed.repartition(max(1, -(-len(found) // FILES_IN_TASK))).mapInArrow(_read_batches, "path string, content binary")


def read_sources(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, content) below paths of any kind: URIs (hdfs://, s3a://, ...) are listed and read by Spark, others by local_files()."""
    paths = list(paths)
    away = [p for p in paths if "://" in p]
    here = [p for p in paths if "://" not in p]
    if not away:
        return local_files(spark, here)
    out = source_files(spark, away).select("path", "content")
    return out.unionByName(local_files(spark, here)) if here else out


def drafted(spark: SparkSession, code: str, lang: str) -> DataFrame:
    """(path, content) of code that is in no file yet; an unknown language is taken as Rust."""
    from ..frontend import EXTENSION_OF

    return spark.createDataFrame([(f"draft{EXTENSION_OF.get(lang.lower(), '.rs')}", code.encode())], "path string, content binary")


#: Files whose units a task holds as objects at a time.
FILES_AT_ONCE = 256


def _unit_batches(profile: str, options: Options | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..frontend import units_of_source

        for b in (b.slice(k, FILES_AT_ONCE) for b in batches for k in range(0, b.num_rows, FILES_AT_ONCE)):
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += units_of_source(path, (content or b"").decode("utf-8", "replace"), profile, options)
                except Exception as e:  # one bad file must not end the scan: it becomes a row that says why
                    rows.append({"name": None, "file": path, "lang": None, "line_start": None, "line_end": None, "code_lines": None, "tokens": None, "features": None, "nodes": None, "unknown": None, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


SCHEMA = pa.schema(
    [
        ("name", pa.string()), ("file", pa.string()), ("lang", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("code_lines", pa.int32()), ("tokens", pa.list_(pa.string())),
        ("features", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32()), ("tag", pa.string())]))), ("nodes", pa.int32()), ("unknown", pa.int32()), ("error", pa.string()),
    ]
)


NODE_SCHEMA = pa.schema(
    [
        ("name", pa.string()), ("file", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("idx", pa.int32()), ("line", pa.int32()), ("label", pa.string()), ("tag", pa.string()), ("emit", pa.bool_()),
        ("commutative", pa.bool_()), ("preds", pa.list_(pa.struct([("idx", pa.int32()), ("pos", pa.int32())]))), ("rounds", pa.list_(pa.int64())),
    ]
)


def _node_batches(options: Options | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..frontend import nodes_of_source

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = nodes_of_source(path, (content or b"").decode("utf-8", "replace"), options)
                except Exception:  # extract_units has a row that says why
                    rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=NODE_SCHEMA)

    return run


def fid() -> Column:
    """The id of a unit: a hash of file, name and lines, so that it is the same in every run and for every partitioning."""
    return F.xxhash64("file", "name", "line_start", "line_end").bitwiseAND(F.lit((1 << 62) - 1)).alias("fid")


def extract_units(files: DataFrame, profile: str = "full", origin: str = "workspace", options: Options | None = None) -> DataFrame:
    """Units of files(path, content) with their features; a file that can't be read gives one row with error."""
    out = files.select("path", "content").mapInArrow(_unit_batches(profile, options), UNITS)
    return out.select(fid(), "*", F.lit(origin).alias("origin"))


def extract_nodes(files: DataFrame, options: Options | None = None) -> DataFrame:
    """The data-flow nodes of all units of files(path, content): fid, idx, line, label, tag, emit, commutative, preds, rounds (a hash for each level)."""
    out = files.select("path", "content").mapInArrow(_node_batches(options), NODES)
    return out.select(fid(), "idx", "line", "label", "tag", "emit", "commutative", "preds", "rounds")


def unit_features(units: DataFrame) -> DataFrame:
    """(fid, h, w) of extracted units, distinct, with the largest weight."""
    rows = units.where("error is null").select("fid", F.explode("features").alias("x")).select("fid", "x.h", "x.w")
    return rows.groupBy("fid", "h").agg(F.max("w").alias("w"))
