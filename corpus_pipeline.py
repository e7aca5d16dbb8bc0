"""The corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing and tokens, one operator a stage.

Each stage works on all that its predecessor kept. The quality rules drop what they reject; of each near-duplicate group one
document stays; secrets in texts are replaced by their kind; the mix drops and repeats documents by its plan; the last stage
returns the tokens. Stages neither rely on unique ids nor on there being rows, and carry extra columns along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm import bpe, mixing, quality_rules, secret_scan, simhash
from needledrop.llm.common import table
from needledrop.llm.queries import vocabulary
from needledrop.plans.storage import new_path, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; ``n_chars`` follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row."""
    return bpe.round_trip(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]
#: Fingerprints, covariance estimates and merges are beyond SQL; the pipeline's test compares each stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again; what a stage writes besides is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
