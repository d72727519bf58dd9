"""Registered queries of the operators: each reads whole tables and runs its
operator with the production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.llm import (
    conversations, fingerprints, hilbert, language, licences, manifest, materialise, near_dedup, packing, passages, pieces, quality, toxicity)
from tripcast.llm.common import documents, held_out, id_and_text, package_on_workers, read_table, written


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    docs = id_and_text(documents(spark, sf_dir))
    return toxicity.score_documents(docs, read_table(spark, sf_dir, "labels")).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    docs = documents(spark, sf_dir)
    return language.identify_documents(id_and_text(docs), docs).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op3_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the whole table; one row a sequence: where it lies."""
    package_on_workers(spark)
    return materialise.materialise(documents(spark, sf_dir))[1]


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``source/hundreds/id``."""
    docs = documents(spark, sf_dir)
    none = F.lit("none")
    path = F.concat_ws("/", F.coalesce("source", none), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), none),
                       F.coalesce(F.col("doc_id").cast("string"), none))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"), ("doc_id",))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return passages.remove_repeats(documents(spark, sf_dir), with_text=False).drop("kept", "spans", "kept_text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return packing.pack_documents(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(fingerprints.fingerprints(documents(spark, sf_dir)), "fingerprints")
    return fingerprints.search(found).select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("fp")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return hilbert.search(vectors, F.col("vec_id") % 100 == 0)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return conversations.repair_conversations(read_table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op4_language": op4_language,
    "op3_materialise": op3_materialise,
    "op5_pieces": op5_pieces,
    "op6_quality": op6_quality,
    "op7_licences": op7_licences,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_nearest": op11_nearest,
    "op12_conversations": op12_conversations,
    "op13_manifest": op13_manifest,
}

ORACLE_SQL: dict[str, str] = {"op6_quality": quality.SQL}
