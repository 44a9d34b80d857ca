"""Corpus pipeline: quality filter, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Stage results are written under the
shared checkpoint folder and read back, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waypoint.llm import mixing, packing
from waypoint.llm.common import table
from waypoint.llm.quality import accepted
from waypoint.llm.simhash import keep_one
from waypoint.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, taught by all labelled ones, rejects."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of every SimHash class (4-word shingles, 4 bits)."""
    return keep_one(docs, shingle=4, max_bits=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out, keeps or repeats whole documents to meet the sources' budgets."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; the pieces of every document."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Classifier, fingerprints and tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
