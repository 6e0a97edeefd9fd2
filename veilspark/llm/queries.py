"""Queries of the corpus operators: one a operator, over whole tables with production parameters; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import chat, licences, mixing, near_dedup, nearest, packing, quality, repeats, secret_scan, sharding
from veilspark.llm.common import documents, staged
from veilspark.llm.sql import ORACLES


def op1_hierarchical_kmeans_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), 16)


def op3_conflict_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op4_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, parsed: conv_id, turn, role, first_line, n_lines, raw, text, rendered. The model is
    fitted on the known roles of at most chat.SAMPLE conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = chat.fit(chat.transcribed(chat.sampled(turns)))
    parsed = chat.canonical(staged(chat.with_roles(chat.transcribed(turns).drop("role"), model), "roles"))
    return parsed.withColumnRenamed("conv", "conv_id")


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.findings(documents(spark, sf_dir)))


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_license_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(documents(spark, sf_dir)).drop("matches")


def op8_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.with_measurements(documents(spark, sf_dir), keep=["doc_id"])
    base = [F.col(f"{quality.MEASURES}.{f}") for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judged(measured).select("doc_id", *base, "base_failed", "kept", "quality")


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4)


def op10_gear_chunk_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(documents(spark, sf_dir)).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hierarchical_kmeans_search,
        op2_karmarkar_karp_shards,
        op3_conflict_best_fit_packing,
        op4_transcript_roles,
        op5_secret_ledger,
        op6_fair_queue_mix,
        op7_license_containment,
        op8_weak_supervision_quality,
        op9_minmax_near_dedup,
        op10_gear_chunk_repeats,
    )
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
