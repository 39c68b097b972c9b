"""The registered query of each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .byte_bpe import digests
from .chaining import passages
from .chroma import group_recordings
from .common import table
from .embedding_dedup import link_vectors
from .mixing import ORACLE as MIXING_ORACLE
from .mixing import mix, source_targets
from .ngram_lm import ORACLE as NGRAM_ORACLE
from .ngram_lm import score
from .quality import classify
from .simhash import simhash_groups
from .suffix_dedup import ORACLE as SUBSTRING_ORACLE
from .suffix_dedup import dedup_substrings
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .vector_codes import compress
from .vector_codes import oracle as codes_oracle


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no table holds audio: a text's bytes are read as 8-bit samples
    return group_recordings(table(spark, sf_dir, "documents"), "doc_id", "text", kind="u8").withColumnRenamed("id", "doc_id")


def op2_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_words", "n_removed", "bigint(size(spans)) as n_spans", "sources")


def op3_mixing_subset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: each source's size and target."""
    return source_targets(table(spark, sf_dir, "documents")).selectExpr("source", "source_size", "round(target, 6) as target")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chroma_fingerprints": op1_chroma_fingerprints,
    "op2_collinear_chaining": op2_collinear_chaining,
    "op3_mixing_subset_sum": op3_mixing_subset_sum,
    "op4_simhash_pigeonring": op4_simhash_pigeonring,
    "op5_sorted_projections": op5_sorted_projections,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_stupid_backoff": op10_stupid_backoff,
    "op11_toxicity": op11_toxicity,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
    "mixing_targets": mixing_targets,
}

ORACLES: dict[str, str] = {
    "op9_suffix_array_dedup": SUBSTRING_ORACLE,
    "op10_stupid_backoff": NGRAM_ORACLE,
    "op12_vector_codes": f"select * exclude (label) from ({codes_oracle()})",
    "mixing_targets": MIXING_ORACLE,
}
