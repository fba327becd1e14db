"""Registered queries: one for each training-text operator, over whole tables and whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrastack.llm import chunk_dedup, hard_negatives, html_extract, licenses, media, minhash, ngram_lm, packing, periodic_runs, piece_bpe, quality, simhash, toxicity
from terrastack.llm.common import narrow, read_table

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow(read_table(spark, sf_dir, "documents"))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG, read back, checked and described; the cosine hash is a binary column."""
    return media.media_features(media.store_media(documents(spark, sf_dir)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality by its labelled neighbours."""
    return quality.score_quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity by its worst words."""
    return toxicity.score_toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the prefix table and decoded again."""
    return piece_bpe.encode_and_decode(documents(spark, sf_dir), PIECE_MODEL).drop("decoded")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the automaton learned from the rows that are not held out."""
    return ngram_lm.score_documents(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of every text, with the document that keeps it."""
    return chunk_dedup.repeated_passages(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, its edited text's, and how near they and the next document's are."""
    return minhash.edited_fingerprints(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in power-of-two sequences."""
    return packing.pack(documents(spark, sf_dir), BYTE_TOKENIZER, public_tokenizers.PATTERN)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of every text that a license or notice matches best."""
    return licenses.scan(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of every text, some with planted periods: how many, the one that repeats most, digests of all and of the text without repeats."""
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(documents(spark, sf_dir))))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.hard_negatives(hard_negatives.scaled_rows(read_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op7_simhash": op7_simhash,
    "op8_minhash": op8_minhash,
    "op10_license_scan": op10_license_scan,
    "op9_packing": op9_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_html_extraction": op12_html_extraction,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op10_license_scan": licenses.oracle_sql()}
