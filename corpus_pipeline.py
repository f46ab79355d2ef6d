"""Documents to training sequences: toxicity, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs; all but the last return the columns of documents, in their order, and any others that docs has.
An empty table goes through every stage as an empty table. Null and repeated ids, null texts and other
nulls are handled as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semblance.llm.common import Scratch, documents
from semblance.llm.mixing import mixed_documents
from semblance.llm.neardup import STAGE, drop_near_duplicates
from semblance.llm.packing import pack
from semblance.llm.secrets import redact_secrets
from semblance.llm.toxicity import drop_toxic, fit, sample_of


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model rejects.

    It is fitted on labelled rows of docs; without labels, or with one kind only, nothing is rejected. Null and empty texts stay.
    """
    return drop_toxic(docs, fit(sample_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with a similarity of 0.8 or more: that of least id, null last.

    Repeated rows and rows without an id are copies like any other. Texts without words are no duplicates and stay.
    """
    return drop_near_duplicates(docs, Scratch(spark, "pipeline-near"), at=STAGE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials replaced in their texts and n_chars brought up to date. Null texts stay null."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the copies that bring each source to its target. A null source is a source; texts without words come as often as their rate's whole copies."""
    return mixed_documents(docs, Scratch(spark, "pipeline-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets. Null and empty texts are a piece of one id; null ids stay null."""
    return pack(docs, Scratch(spark, "pipeline-pack"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("pack", pack_sequences),
]

#: Byte-level BPE and a fitted model have no SQL; tests/llm holds each stage against a version written anew, by hand and without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    *early, (_, last) = STAGES
    for k, (_, stage) in enumerate(early):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return last(spark, docs, sf_dir)
