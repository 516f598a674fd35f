"""The corpus pipeline: from documents to token ids.

STAGES are applied in order; each works on all that its predecessor kept, and is
given and returns a DataFrame of the columns of documents (the last one returns
the tokens).  Between stages the rows are written as Parquet and read again.

Null and empty texts: quality scores them like any other text; those that stay are one
near-duplicate group, have no window of the benchmark, no secret and no token.  Repeated
rows: one stays after the second stage.  Different texts of one id are different
documents throughout.  Null ids are documents like others, last where ids decide.  An
empty table gives an empty one; without benchmark items nothing is dropped.  Further
columns are carried along up to the last stage, whatever their names.  Texts of any
length are worked on whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash
from tidemark.llm.common import remove, shared_folder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer does not reject."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity of 0.8 or more), that of the smallest id."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs, n_chars_col="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32 bit), decoded_sha256 of each document."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("secrets", redacted), ("tokens", encoded)]

#: SQL expresses neither the fitted scorer nor the components; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; stages are written to the shared checkpoint folder, and deleted once the next one is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
