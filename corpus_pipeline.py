"""The corpus pipeline: its stages in order, each a function of (spark, docs, sf_dir) that returns a DataFrame.

Rejected documents go, repeated runs of lines are deleted, one document of each near-duplicate group stays, the rest is
mixed to target weights (a document taken twice is there twice), and the mix is packed into sequences. All stages but the
last return the columns of documents; run() writes each stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import classifier, line_dedup, mixing, near_copies, packing
from siltstone.llm.common import cut, table
from siltstone.llm.token_ids import default_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are likely good and not likely toxic, unchanged."""
    return classifier.keep(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later runs of 50 words that repeat; n_chars is that of what is left."""
    left = line_dedup.dedup(docs).drop("n_deleted")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast("long"))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id, unchanged."""
    return near_copies.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.resample(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, default_vocabulary())


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Classifier, components and packing can't be told in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
