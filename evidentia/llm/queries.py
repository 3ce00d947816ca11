"""The queries opN_* over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, htmltext, kmeans, langid, licenses, linededup, merkle, mixing, quality, simhash, substring, tokencounts
from .common import documents, saved, scratch_dir


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, as a ledger comes to them: every document is counted once and its counts are kept.

    Half of the documents (by hash) come in a first batch, of these a part with a
    count that a later batch revises; the rest comes in a second batch together with
    documents that a third one deletes again. A batch that comes twice counts once.
    """
    docs = documents(spark, sf_dir)
    ledger = tokencounts.Ledger(spark, f"{scratch_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    docs = docs.withColumn("share", F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(8)))
    both = [tokencounts.counts(docs, v, also=("share",)) for v in ("words-1", "word_bpe_49k-1")]
    counted = saved(both[0].unionByName(both[1]), "token-rows")
    part = lambda low, high: counted.filter(F.col("share").between(low, high)).drop("share")
    first = part(0, 1).withColumn("tokens", F.col("tokens") + 7)
    ledger.commit("1", inserted=first.unionByName(part(2, 3)))
    ledger.commit("2", inserted=part(4, 7).unionByName(part(6, 6)))
    ledger.commit("3", deleted=part(6, 6), revised=part(0, 1).withColumn("old_tokens", F.col("tokens") + 7))
    ledger.commit("2", inserted=part(4, 7))
    return ledger.totals()


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_successors(documents(spark, sf_dir))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return htmltext.extract(pages, htmltext.train(pages))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.digests(conversations.repair(rows, "copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
