"""What the text operators share: reading `documents`, hash splits, checkpoint folder, model shipping."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.sources.shared import shared_folder

#: ASCII white space that ends a word: space and \x09-\x0D. bytes.split() and this pattern agree.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty. Extra columns of any name are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_remainder(divisor: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of spark.checkpoint.dir; only a local session makes one of its own, as in tests."""
    shared_folder(spark)


def give_back() -> None:
    """Returns memory that this worker has freed to the system: workers live long, and what they keep others lack."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes of text) of the whole table: sizes the blocks of a job, decides no result."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def block_count(docs: DataFrame, block_bytes: int) -> int:
    rows, size = text_bytes(docs)
    return max(1, -(-(size + 32 * rows) // block_bytes))
