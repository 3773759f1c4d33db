"""A training corpus in five stages.

Each stage takes the documents that the one before kept, and all but the last
return rows with the columns of `documents`:

1. quality: documents that the classifier rejects go;
2. near_dups: the first document of each group of near copies stays;
3. decontamination: documents that hold a benchmark item go;
4. secrets: secrets in texts are masked, all documents stay;
5. packing: the rest is cut into pieces and packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loglake.llm import decontaminate, near_dups, packing, quality, secret_scan
from loglake.session import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
BATCH_BYTES = "4m"  # of rows that a stage hands to Python at once


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, which else hold 10,000 rows of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_documents(docs, labels))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dups.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, TOKENIZER, END_ID, with_ids=False, plain=True)


STAGES = [
    ("quality", good_quality),
    ("near_dups", first_of_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", secrets_masked),
    ("packing", packed),
]

# The classifier, the sketches and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
