"""The operators of this subpackage over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgauge.llm import bpe, centroids, chats, decontaminate, embeddings, exact, langid, lexical, licenses, lm, pii, simhash, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_table(spark, folder, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict_languages(_table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op7_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(_table(spark, folder, "documents"))


def op8_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chats.maximal_conversations(_table(spark, folder, "conversations"))


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, folder, "embeddings"))


def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = exact.find_copies(docs.withColumn("text_sha256", exact.digest(F.col("text"))))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_language": op4_language,
    "op5_licenses": op5_licenses,
    "op6_embeddings": op6_embeddings,
    "op7_lm": op7_lm,
    "op8_chats": op8_chats,
    "op9_bpe": op9_bpe,
    "op10_urls": op10_urls,
    "op11_lexical": op11_lexical,
    "op12_centroids": op12_centroids,
    "op13_exact": op13_exact,
    "pipeline": corpus_pipeline.run,
}

#: The others can't be expressed in SQL; the tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op8_chats": chats.ORACLE,
    "op10_urls": urls.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_exact": exact.ORACLE,
}
