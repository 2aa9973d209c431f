"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept; all but the last return the columns of
``documents``.  The last returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilwright.llm.common import Tables, documents
from veilwright.llm.exact_dedup import drop_copies
from veilwright.llm.packing import pack
from veilwright.llm.queries import VOCABULARY
from veilwright.llm.secrets import redact_secrets
from veilwright.llm.simhash import one_of_each_group
from veilwright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of the labelled documents among them."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the smallest id of its class."""
    return one_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced in their texts."""
    return redact_secrets(docs, path_col="source", length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_dedup), ("secret scans", secret_scan), ("packing", packing)]

#: The learned toxicity model and the packing order have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and reread."""
    tables = Tables(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir))
    return docs
