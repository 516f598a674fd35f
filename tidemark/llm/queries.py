"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, minhash, quality, secrets, simhash, suffixes, toxicity, urls
from .common import hex_of, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    near = minhash.compare_edits(docs, notes=minhash.near_duplicates(docs))
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("signature")).alias("fingerprint"), F.lower(F.hex("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next", F.col("note").alias("cluster_id"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, where=~toxicity.held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, _ = quality.fit(docs)
    scored = quality.score(docs.select("doc_id", "text"), weights, score_col="score")
    return scored.select("doc_id", "score", (F.col("score") >= quality.KEEP).alias("keep"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, width=1, radius=4)
    return found.select("doc_id", hex_of(F.get("fingerprint", 0)).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_minhash, op3_decontamination, op4_urls, op5_toxicity, op6_suffixes, op7_chat, op8_quality, op9_simhash, op10_secrets)}
