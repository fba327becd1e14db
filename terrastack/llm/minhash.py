"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Each shingle of five words is hashed once; the hash's high bits name a bin and the bin keeps its smallest hash. Empty bins are filled by optimal
densification: each draws other bins in a fixed random order of its own until it meets one that is not empty. A fingerprint is the low-order
eight bits of every bin. The share of equal bins, corrected for chance agreement of eight bits, estimates the Jaccard likeness.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SHINGLE_WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Draws written out for each empty bin; bins that are still empty take the first in a random order of all bins.
DRAWS = 12
#: Bytes of text in a range of doc_id, ranges of one level, and ranges in all.
RANGE_BYTES, LEAVES, MOST_RANGES = 4_000_000, 512, 65_536
_LOWEST = -(1 << 63)


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the shingles of words (cut at ASCII white space, A-Z lower-cased); of the whole text if it is shorter."""
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _bins(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: an array of BINS signed bytes. Steps are columns of their own, so that no array is built anew for each of its elements."""
    sentinels = F.array(*[F.lit(int(np.int64(np.uint64((b << (64 - BIN_BITS)) | ((1 << (64 - BIN_BITS)) - 1))))) for b in range(BINS)])
    empty = (1 << (64 - BIN_BITS)) - 1
    draws = np.random.default_rng(97).integers(0, BINS, (DRAWS, BINS))
    tables = [F.array(*[F.lit(int(x)) for x in row]) for row in draws]
    words, hashes, least, open_, full, filled = (f"{out}_{i}_" for i in range(6))
    frame = frame.withColumn(words, shingle_hashes(F.col(text)))
    count = F.size(words)
    places = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(count - SHINGLE_WORDS, F.lit(0))))
    shingle = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE_WORDS)])
    frame = frame.withColumn(hashes, F.sort_array(F.concat(F.transform(places, shingle), sentinels)))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    frame = frame.withColumn(least, F.filter(F.col(hashes), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(hashes), i - 1)))))
    frame = frame.withColumn(open_, F.transform(F.col(least), lambda x: F.when(x.bitwiseAND(F.lit(empty)) != empty, x)))
    frame = frame.withColumn(full, F.filter(F.transform(F.col(open_), lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
    last = lambda i: F.array_min(F.transform(F.col(full), lambda j: F.struct(F.xxhash64(i, j).alias("h"), F.get(F.col(open_), j).alias("v"))))["v"]
    fill = lambda x, i: F.coalesce(x, *[F.get(F.col(open_), F.get(t, i)) for t in tables], last(i), F.lit(0))
    frame = frame.withColumn(filled, F.transform(F.col(open_), fill))
    low = (1 << LOW_BITS) - 1
    frame = frame.withColumn(out, F.transform(F.col(filled), lambda x: (x.bitwiseAND(F.lit(low)) - (1 << (LOW_BITS - 1))).cast("tinyint")))
    return frame.drop(words, hashes, least, open_, full, filled)


def packed(bins: Column) -> Column:
    """The bins' low-order bits as hexadecimal text, two digits a bin."""
    return F.lower(F.array_join(F.transform(bins, lambda b: F.lpad(F.hex(b.cast("int") + (1 << (LOW_BITS - 1))), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two arrays of bins, corrected for bins that agree by chance; 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    chance = 2.0**-LOW_BITS
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance)))


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "bins") -> DataFrame:
    """`docs` with `out`, the fingerprint of the column `text` as an array of bytes; equal texts have equal fingerprints.

    Null texts count as empty; texts of any length are hashed whole. A text without words has a fingerprint of zeros, and is like other such texts only. Repeated rows
    and rows with a null doc_id are rows like others; empty tables stay empty. The other columns stay, but for those named `out` or `out`_0_ to `out`_5_, which
    are overwritten.
    """
    return _bins(docs, text, out)


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """(number of the range of doc_id that key_ falls in, in ascending order; how many). Ranges hold about equally many rows.

    Two levels: up to LEAVES ranges between quantiles, found by a tree of comparisons, each cut into equal widths.
    """
    key = F.col("key_")
    found = docs.agg(F.sum(F.octet_length("text") + 64).alias("b"), F.percentile_approx("key_", [i / LEAVES for i in range(LEAVES + 1)], 20 * LEAVES).alias("q")).first()
    many = max(1, min(MOST_RANGES, -(-int(found["b"] or 0) // RANGE_BYTES)))
    leaves, parts = min(many, LEAVES), -(-many // LEAVES)
    quantiles = found["q"] or [0] * (LEAVES + 1)
    splits = sorted({int(quantiles[LEAVES * i // leaves]) for i in range(1, leaves)})

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(splits[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    leaf = tree(0, len(splits))
    if parts == 1:
        return leaf, len(splits) + 1
    edges = [int(quantiles[0]), *splits, int(quantiles[-1]) + 1]
    low, high = (F.get(F.array(*[F.lit(float(e)) for e in side]), leaf) for side in (edges[:-1], edges[1:]))
    inside = F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * parts)
    return leaf * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)).cast("int"), (len(splits) + 1) * parts


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` (doc_id, text, ...) with next_<column> of the row that follows in ascending (doc_id, text); after the last comes the first.

    Rows are dealt to ranges of doc_id; the first rows of each range are also sent, marked, to the end of the range before it. A table of
    one bounded row for each range (at most MOST_RANGES) is all that is broadcast. Null ids come first.
    """
    keyed = docs.withColumn("key_", F.coalesce(F.col("doc_id"), F.lit(_LOWEST)))
    number, _ = _ranges(keyed)
    dealt = keyed.withColumn("range_", number)
    firsts = keyed.select("key_").withColumn("range_", number).groupBy("range_").agg(F.min("key_").alias("first_"))
    around = W.orderBy("range_")
    before = firsts.select("first_", F.coalesce(F.lag("range_").over(around), F.max("range_").over(W.partitionBy())).alias("to_"))
    marked = dealt.join(F.broadcast(before), F.col("key_") == F.col("first_")).withColumn("range_", F.col("to_")).drop("first_", "to_").withColumn("mark_", F.lit(1))
    order = W.partitionBy("range_").orderBy("mark_", "key_", "text")
    both = dealt.withColumn("mark_", F.lit(0)).unionByName(marked)
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return both.where("mark_ = 0").drop("mark_", "range_", "key_")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's, in ascending
    doc_id; after the last document comes the first, and a table of one row follows itself. Null and empty texts have nothing to replace; texts of any length
    are taken whole; rows that share a doc_id (repeated rows among them) follow each other by text; rows with a null doc_id come first, and all in one range, so
    that a table with many of them is slow. Empty tables give no rows. Other columns, whatever their names, are left out.
    """
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprints(narrow, "text", "bins")
    followed = with_next(own, ["text", "bins"])
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    followed = followed.withColumn("edited_", edited).withColumn("n_chars", chars.cast("long")).drop("next_text", "text")
    both = with_fingerprints(followed, "edited_", "edited_bins")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
