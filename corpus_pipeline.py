"""A training-text pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever they are. Stages are
chained through Parquet, each working on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.llm import chunk_dedup, near_copies, packing, quality, toxicity
from terrastack.llm.common import ensure_checkpoint_dir, read_table

#: A document goes if its quality score is below this, or its toxicity score is this or more.
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches KEEP_QUALITY. The model learns from the labelled documents among `docs` that are not held out.

    Without examples of both labels all documents stay. Null and empty texts are scored by their lack of words, texts of any length whole; equal texts share
    their fate (a score of just KEEP_QUALITY stays); repeated rows, and rows with a null doc_id, are judged each; an empty table stays empty; other columns,
    whatever their names, stay as they are.
    """
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    if not model.value.taught:
        return docs
    return docs.where(quality.score_column(model, F.col("text")) >= KEEP_QUALITY)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below DROP_TOXIC. The model learns from the labelled documents among `docs` that are not held out.

    Without examples of both labels all documents stay. Null and empty texts score what the model's bias gives, texts of any length by their worst words; equal texts
    share their fate (a score of just DROP_TOXIC goes); repeated rows, and rows with a null doc_id, are judged each; an empty table stays empty; other
    columns, whatever their names, stay as they are.
    """
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    if not model.value.taught:
        return docs
    return docs.where(toxicity.score_column(model, F.col("text")) < DROP_TOXIC)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash fingerprints in BK-trees, then a five-word likeness of 0.8 or more): the one with the smallest doc_id.

    Texts without words (null and empty ones) are one group; texts of any length are compared whole. Of several rows with the smallest doc_id the first by the hash of its
    text stays; rows with a null doc_id come last; an empty table stays empty; other columns, whatever their names, stay as they are.
    """
    return near_copies.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; n_chars, where it is there, is counted anew.

    Null and empty texts stay as they are; texts of any length are searched whole; of equal passages the one with the smallest doc_id, then place, stays; rows equal in doc_id and
    text keep theirs, rows with a null doc_id come last; an empty table stays empty; other columns, whatever their names, stay as they are.
    """
    return chunk_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of power-of-two lengths.

    Null and empty texts are one piece of the end id; texts of any length are packed whole; repeated rows, and rows with a null doc_id, have pieces of their own; sequences of
    one length go by doc_id and place in any order that is the same each time; an empty table gives none; other columns are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]
#: SQL cannot train the classifiers: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
