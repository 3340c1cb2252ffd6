"""A training-data pipeline over ``documents``: five stages, each one of the operators in tallygrid.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as
Parquet and read again as the next stage's documents. All but the last return the columns of
``documents``. Each stage works on all rows its predecessor kept.

1. quality rules: documents that fail the base rules or repeat themselves go.
2. near duplicates: of each group of documents linked by n-gram Jaccard similarity one stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret found in a text is replaced by a mask; n_chars follows the text.
5. packing: documents become pieces of training sequences of 4096 tokens.

Nulls, empty and very long texts, ties, repeated rows and empty tables are handled by the
operators, whose docstrings give the results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.llm import decontaminate, jaccard, packing, quality, secrets
from tallygrid.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, keep_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL cannot encode tokens, so tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the checkpoint folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
