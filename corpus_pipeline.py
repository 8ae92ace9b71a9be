"""From raw documents to packed sequences: quality filter, near-duplicates, personal data, mixing, packing.

Each stage takes the rows its predecessor kept, in the columns of documents; the last returns the packed pieces.

Nulls in any column pass: a null text is scored, hashed and packed as an empty one, rows without a doc_id are documents
like any others, and a null source is a source of its own. Blank texts are near-duplicates of each other, so one stays
if the classifier keeps it. Repeated rows are copies, of which one stays; different texts under one doc_id all stay.
Ties go to the smallest doc_id, then to a hash of the text. Very long texts are read whole in every stage. An empty
table stays empty through all stages. Extra columns pass every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import mixing, packing, pii, quality, simhash
from labelloom.llm.common import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data generalised."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.packed(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("personal_data", clean), ("mixing", mix), ("packing", pack)]

#: SQL can't express the classifier, the fingerprints or the tokens; the tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
