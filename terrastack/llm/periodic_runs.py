"""Periodic runs of words: stretches that repeat themselves at a fixed distance.

Runs theorem (Bannai et al., "The Runs Theorem"): each run has a Lyndon root that is the longest Lyndon word at its place under the order of words or under the
reversed order, and longest Lyndon words end at the next smaller value of the inverse suffix array. So each place has two candidate roots; how far a root goes
on repeating to either side is a longest common extension, the least value of a range of LCP values (sparse table).

Documents are worked on in blocks: their words stand one after another, with separators that are all different and smaller than any word under both orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.common import WORD_PATTERN

#: A run counts if it is at least so many words long, and at least so many times its period.
MIN_WORDS, MIN_REPEATS = 6, 4
#: Words of a block, a longer document being a block of its own. Decides no result.
BLOCK_WORDS = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; each round sorts only suffixes that aren't told apart yet. `text` ends with a value that occurs once."""
    many = len(text)
    _, rank, counts = np.unique(text, return_inverse=True, return_counts=True)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    open_ = np.flatnonzero(counts[rank] > 1)
    rank = first[rank]
    step = 1
    while len(open_):
        after = rank[np.minimum(open_ + step, many - 1)]  # a suffix that is not told apart goes on for `step` words and more
        key = rank[open_] * many + after
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        old = rank[open_]
        new_group = np.concatenate(([True], key[1:] != key[:-1]))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        base = np.maximum.accumulate(np.where(new_old, at, 0))
        rank[open_] = old + start - base
        alone = new_group & np.concatenate((new_group[1:], [True]))
        open_ = open_[~alone]
        step *= 2
    suffixes = np.empty(many, np.int64)
    suffixes[rank] = np.arange(many)
    return suffixes, rank


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in suffix order (Kasai et al.)."""
    words, order, place = text.tolist(), suffixes.tolist(), rank.tolist()
    found, same, many = [0] * len(words), 0, len(words)
    for i in range(many):
        at = place[i]
        if not at:
            same = 0
            continue
        j = order[at - 1]
        most = many - (i if i > j else j)
        while same < most and words[i + same] == words[j + same]:
            same += 1
        found[at] = same
        same = same - 1 if same else 0
    return np.array(found, np.int32)


def common_extensions(lcp: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at `left` and `right` (different places): least LCP of a range. One level of the sparse table is held at a time."""
    low = np.minimum(rank[left], rank[right]) + 1
    high = np.maximum(rank[left], rank[right]) + 1
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
    found, table = np.empty(len(left), np.int64), lcp
    for k in range(len(ends) - 1):
        mine = order[ends[k] : ends[k + 1]]
        found[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return found


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place to the right with a smaller value; the number of values if there is none."""
    rank = values.tolist()
    many = len(rank)
    rank.append(-1)
    found = [many] * (many + 1)
    for i in range(many - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = found[j]
        found[i] = j
    return np.array(found[:many])


def runs_between(text: np.ndarray, separators: int, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """(start, length, period) of each run, by start and period. Values below `separators` occur once each; the first and last value are such."""
    many = len(text)
    suffixes, rank = suffix_order(text)
    lcp = common_prefixes(text, suffixes, rank)
    back_order, back_rank = suffix_order(text[::-1])
    back_lcp = common_prefixes(text[::-1], back_order, back_rank)
    turned = np.where(text < separators, text, separators + text.max(initial=0) - text)
    places = np.flatnonzero(text >= separators)
    found = []
    for order in (rank, suffix_order(turned)[1]):
        end = next_smaller(order)[places]
        after = common_extensions(lcp, rank, places, end)
        before = common_extensions(back_lcp, back_rank, many - places, many - end)
        length = before + (end - places) + after
        good = length >= np.maximum(min_words, min_repeats * (end - places))
        found.append(np.stack((places - before, end - places, length), 1)[good])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _stretches(words: np.ndarray, document: np.ndarray, min_words: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each stretch that can hold runs: a run holds each of its words `min_repeats` times, so rarer words cut a text.

    Cutting is repeated while it takes off much; what it leaves is searched as it is.
    """
    place, part = np.arange(len(words)), document
    kinds = int(words.max(initial=0)) + 1
    while True:
        _, key, counts = np.unique(part * kinds + words[place], return_inverse=True, return_counts=True)
        keep = counts[key] >= min_repeats
        left, owner = place[keep], part[keep]
        new = np.ones(len(left), bool)
        new[1:] = (np.diff(left) > 1) | (owner[1:] != owner[:-1])
        number = np.cumsum(new) - 1
        sizes = np.bincount(number, minlength=1)
        keep = sizes[number] >= min_words
        left, number = left[keep], number[keep]
        done = len(left) > 0.9 * len(place) or not len(left)
        place, part = left, number
        if done:
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(part)) if len(part) else starts
            return place[starts], (place[ends - 1] + 1 if len(part) else ends)


def runs_of(documents: list[np.ndarray], min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[np.ndarray]:
    """The runs of each document, given as arrays of word numbers that all documents share: (start, length, period), by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return [np.empty((0, 3), np.int64)] * len(documents)
    words = np.concatenate(documents).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    starts, ends = _stretches(words, np.repeat(np.arange(len(documents)), sizes), min_words, min_repeats)
    if not len(starts):
        return [np.empty((0, 3), np.int64)] * len(documents)
    # separator, stretch, separator, ..., separator
    lengths = ends - starts
    separators = len(starts) + 1
    text = np.empty(lengths.sum() + separators, np.int64)
    moved = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    places = np.arange(lengths.sum()) + np.repeat(np.arange(len(starts)), lengths) + 1
    text[places] = np.unique(words[moved], return_inverse=True)[1] + separators
    text[np.concatenate(([0], np.cumsum(lengths + 1)))] = np.arange(separators)
    found = runs_between(text, separators, min_words, min_repeats)
    origin = np.zeros(len(text), np.int64)
    origin[places] = moved
    found[:, 0] = origin[found[:, 0]]
    document = np.searchsorted(first, found[:, 0], side="right") - 1
    found[:, 0] -= first[document]
    return np.split(found, np.searchsorted(document, np.arange(1, len(documents))))


def repeated_words(runs: np.ndarray, many: int) -> np.ndarray:
    """Whether each word lies in a run after that run's first period."""
    change = np.zeros(many + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:many] > 0


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start and period), collapsed (the text's words without those that only repeat a run's first period).

    A run is a stretch of words with smallest period q, `min_words` and `min_repeats` * q words long at least, that no neighbouring word extends. Null and empty texts have no
    words, no runs and an empty collapsed text. Texts of any length are searched whole (a block of its own takes some 300 bytes a word). Runs may overlap; each is told.
    Repeated rows, and rows with a null doc_id, are searched each; an empty table gives none; other columns, whatever their names, are left out.
    """

    def block(ids: list, texts: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        starts, lengths, periods, many, kept = [], [], [], [], []
        for words, runs in zip(texts, runs_of(numbers, min_words, min_repeats), strict=True):
            starts += runs[:, 0].tolist()
            lengths += runs[:, 1].tolist()
            periods += runs[:, 2].tolist()
            many.append(len(runs))
            if len(runs):
                words = [words[i] for i in np.flatnonzero(~repeated_words(runs, len(words)))]
            kept.append(b" ".join(words).decode())
        offsets = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
        fields = [pa.array(x, pa.int64()) for x in (starts, lengths, periods)]
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        counts = pa.array([len(n) for n in numbers], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), counts, runs, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, texts, numbers, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if ids and size + len(words) > BLOCK_WORDS:
                    yield block(ids, texts, numbers)
                    ids, texts, numbers, size, known = [], [], [], 0, {}
                ids.append(doc_id)
                texts.append(words)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                size += len(words)
        if ids:
            yield block(ids, texts, numbers)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by h = crc32 of the decimal doc_id) has a planted period: with n words, g = floor(h / 10) and a = g % n, its word i >= a
    becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)); its words are joined by one space. A null doc_id counts as an empty text, a null text too."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), crc.alias("h"))
    rows = rows.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))).alias("words"))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("long")))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("words"), place(i))), " ")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the run with the greatest length / period (ties: smallest start, then period; no run: nulls), runs_sha256, collapsed_sha256, n_words."""
    better = "best.length * r.period < r.length * best.period"  # exact; runs come by start and period, so of equal ones the first stays
    best = F.expr(f"aggregate(runs, cast(NULL AS struct<start: bigint, length: bigint, period: bigint>), (best, r) -> CASE WHEN best IS NULL OR {better} THEN r ELSE best END)")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.withColumn("best", best)
    named = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli")
    hashes = F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *named, milli, *hashes, "n_words")
