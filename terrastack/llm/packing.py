"""Packing by power-of-two decomposition: each document's tokens are cut into pieces of power-of-two lengths, and each piece is a
sequence of its own. Equal lengths share a bucket, so batches need no padding and no sequence crosses documents.

Sequences are numbered bucket by bucket, longest first, from the counts of blocks and of groups of blocks: no global sort.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from terrastack.llm.common import ensure_checkpoint_dir, give_back

MAX_LENGTH = 2048
END_ID = 1
#: Rows of pieces for each numbering block.
BLOCK_ROWS = 50_000
#: Numbering blocks whose counts are added up together.
GROUPED = 1000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteCodec:
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: merges by rank, the same ids at ten times the speed.

    Where tiktoken gives up (its pattern engine cannot take very long runs of white space) the tokenizers library itself encodes the text. The
    file's added tokens stay special: their strings in a text get their ids, as the library does by default.
    """

    def __init__(self, spec: bytes, pattern: str):
        self.spec, known = spec, json.loads(spec)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in known["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in known["model"]["vocab"].items() if piece not in special}
        self.fast, self.special = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), frozenset(special)

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.spec.decode("utf-8"))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text with the end id."""
        try:
            ids = self.fast.encode(text, allowed_special=self.special, disallowed_special=())
        except ValueError:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END_ID], "<u4")


#: Codecs of this worker by the digest of their file and pattern: at most two at a time.
_CODECS: dict[tuple[str, str], ByteCodec] = {}


def load_codec(spec: bytes, pattern: str) -> ByteCodec:
    key = hashlib.sha256(spec).hexdigest(), pattern
    if key not in _CODECS:
        if len(_CODECS) > 1:
            _CODECS.clear()
        _CODECS[key] = ByteCodec(spec, pattern)
    return _CODECS[key]


def piece_lengths(tokens: int, most: int = MAX_LENGTH) -> list[int]:
    """Lengths that add up to `tokens`: full pieces of `most`, then the powers of two in what is left, longest first."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer: str, pattern: str, most: int = MAX_LENGTH) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens: one row for each piece of each row of `docs`.

    Null and empty texts have the end id alone: one piece of length 1. Texts of any length are encoded whole. Repeated rows, and rows with a null doc_id, have
    pieces of their own; empty tables have none; other columns, whatever their names, are left out. `most` must be a power of two. `tokenizer` is a path
    on the driver; the file, which no table makes longer, is broadcast.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    with open(tokenizer, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(shipped.value, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids, start = codec.encode(text or ""), 0
                    for length in piece_lengths(len(ids), most):
                        rows.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids)))
                        start += length
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])
            give_back()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, start long, length long, ids binary, doc_tokens long")


def ids_crc32(ids: str = "ids"):
    return F.crc32(F.col(ids))


def number_sequences(pieces: DataFrame, blocks: int) -> DataFrame:
    """Adds sequence_id (0, 1, ... over all pieces, bucket after bucket, longest first) and offset (always 0) to `pieces`.

    Pieces are dealt to `blocks` by doc_id and start; within a block and bucket they are numbered by (doc_id, start, ids_crc32, doc_tokens), rows equal in
    all of these in any order. The blocks' counts give each its first number, in two levels: GROUPED blocks make a group, and only a row for
    each bucket and group (50 million pieces) meets in one place. Repeated rows get numbers of their own.
    """
    keyed = pieces.withColumn("block_", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    counts = keyed.groupBy("length", "block_").agg(F.count(F.lit(1)).alias("n_")).withColumn("group_", F.floor(F.col("block_") / GROUPED))
    up_to = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("length", "group_").agg(F.sum("n_").alias("n_"))
    groups = groups.select("length", "group_", up_to(W.orderBy(F.col("length").desc(), "group_")).alias("base_"))
    inside = counts.select("length", "group_", "block_", up_to(W.partitionBy("length", "group_").orderBy("block_")).alias("more_"))
    first = inside.join(groups, ["length", "group_"]).select("length", "block_", (F.col("base_") + F.col("more_")).alias("first_"))
    within = W.partitionBy("length", "block_").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = keyed.withColumn("place_", F.row_number().over(within))
    return (
        numbered.join(first, ["length", "block_"])
        .withColumn("sequence_id", F.col("first_") + F.col("place_") - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("first_", "place_", "block_")
    )


def pack(docs: DataFrame, tokenizer: str, pattern: str, most: int = MAX_LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece; each id lies in exactly one.

    Sequence lengths are powers of two up to `most`, so nothing is padded. Texts are tokenized once: the pieces' plain columns are
    checkpointed before they are numbered. What decompose says of nulls, lengths, repeated rows, empty tables and other columns holds.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    pieces = decompose(docs, tokenizer, pattern, most).select("doc_id", "start", "length", ids_crc32().alias("ids_crc32"), "doc_tokens").checkpoint()
    blocks = max(1, -(-pieces.count() // BLOCK_ROWS))
    return number_sequences(pieces, blocks).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
