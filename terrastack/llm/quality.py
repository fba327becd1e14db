"""Quality by nearest neighbours in a latent-semantic space.

A text becomes counts of hashed features: letter trigrams, trigrams of its letters' shapes, and how its words repeat. Counts are damped, weighed by
inverse document frequency and projected on the leading singular vectors of a bounded sample of labelled texts. The labelled texts'
vectors are broadcast (at most MAX_LABELLED x DIMENSIONS numbers); every document is compared with all of them by exact cosine
products, block against block, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.llm.common import give_back, id_remainder

#: Labelled rows that a model is fitted on at most, half of them of either label, as the hash of their ids falls.
MAX_LABELLED = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Buckets of letter trigrams, of shape trigrams, and of word features.
RAW, SHAPE, WORD = 2048, 1024, 64
FEATURES = RAW + SHAPE + WORD
#: Texts whose feature counts are held at a time, and their characters.
BATCH_TEXTS, BATCH_CHARS = 256, 200_000
#: Damped counts are whole numbers of 1 / STEP, components of vectors of 1 / GRID: FEATURES products of two of them stay below 2^53.
STEP, GRID = 1 << 12, 1 << 20
_LOGS = np.log1p(np.arange(1 << 16))


def _shapes() -> np.ndarray:
    """Of each code point below 0x250: itself if not alphanumeric, else a mark for small letters, capitals or digits."""
    table = np.arange(0x250, dtype=np.uint32)
    for c in range(0x250):
        letter = chr(c)
        table[c] = 1 if letter.islower() else 2 if letter.isupper() else 3 if letter.isdigit() else 4 if letter.isspace() else c
    return table


_SHAPES = _shapes()


def _hashed(a: np.ndarray, buckets: int) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % buckets


def _trigrams(codes: np.ndarray) -> np.ndarray:
    wide = codes.astype(np.uint64)
    return (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]


def _word_features(text: str) -> np.ndarray:
    """Counts over WORD buckets: words, repeats of the word before and of the one before that, repeats of any earlier word, by length of word."""
    out = np.zeros(WORD)
    words = text.split()
    if not words:
        out[0] = 1
        return out
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 19)
    out[1] = len(words)
    out[2] = (ids[1:] == ids[:-1]).sum()
    out[3] = (ids[2:] == ids[:-2]).sum()
    pairs = ids[1:] * len(numbers) + ids[:-1]
    out[4] = len(pairs) - len(np.unique(pairs))
    out[5 + min(9, int(10 * out[2] / len(words)))] = len(words)
    out[15 + min(9, int(10 * out[4] / len(words)))] = len(words)
    out[25:45] = np.bincount(lengths, minlength=20)
    return out


def features(texts: list[str | None], out: np.ndarray | None = None) -> np.ndarray:
    """(texts, FEATURES) counts of whole texts, put into `out` if it is given; a null text counts as empty."""
    out = np.zeros((len(texts), FEATURES), np.float32) if out is None else out
    for i, text in enumerate(texts):
        text = text or ""
        out[i, RAW + SHAPE :] = _word_features(text)
        codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        for start in range(0, len(codes) - 2, BATCH_CHARS):
            part = codes[start : start + BATCH_CHARS + 2]
            shape = np.where(part < len(_SHAPES), _SHAPES[np.minimum(part, len(_SHAPES) - 1)], 1)
            out[i, :RAW] += np.bincount(_hashed(_trigrams(part), RAW), minlength=RAW)
            out[i, RAW : RAW + SHAPE] += np.bincount(_hashed(_trigrams(shape), SHAPE), minlength=SHAPE)
    return out


@dataclass
class NeighbourModel:
    """Feature weights, projection (whole steps of 1 / GRID), and the labelled vectors (likewise) with their labels."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @property
    def taught(self) -> bool:
        """Whether there were examples of both labels."""
        return len(np.unique(self.labels)) == 2

    def project(self, damped: np.ndarray) -> np.ndarray:
        """Unit vectors of texts given by their damped counts, in whole steps of 1 / GRID; a text without any known feature is the zero vector.

        All sums are of whole numbers and stay below 2^53, so they are exact, whatever their order: a text has the same vector in any company.
        """
        flat = damped @ self.projection
        flat = np.rint(flat * (GRID / np.maximum(np.abs(flat).max(1, keepdims=True), 1)))
        norm = np.sqrt((flat * flat).sum(1, keepdims=True))
        return np.rint(flat * (GRID / np.maximum(norm, 1)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of the nearest neighbours' similarity that is of label 1; 0.5 without labelled rows. Of equal cosines the labelled row that comes first counts.

        Cosines are exact whole numbers, and weights are added up in the order of the neighbours' places, so that a text scores the same in any company.
        """
        many = len(self.labels)
        if not many:
            return np.full(len(texts), 0.5)
        nearest = min(self.neighbours, many)
        scores = np.empty(len(texts))
        for start in range(0, len(texts), BATCH_TEXTS):
            own = texts[start : start + BATCH_TEXTS]
            cosines = (self.project(damped(features(own), self.weight)) @ self.vectors.T).astype(np.int64)
            best = np.sort(np.argpartition(np.arange(many) - cosines * many, nearest - 1, axis=1)[:, :nearest], axis=1)
            weight = np.maximum(np.take_along_axis(cosines, best, 1) / GRID**2, 0)
            for _ in range(3):  # the eighth power
                weight = weight * weight
            weight += 1e-12
            votes, total = np.zeros(len(own)), np.zeros(len(own))
            for place in range(nearest):
                votes += weight[:, place] * self.labels[best[:, place]]
                total += weight[:, place]
            scores[start : start + len(own)] = votes / total
        return np.clip(scores, 0.0, 1.0)


def damped(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log(1 + count) times the feature's weight in whole steps of 1 / STEP, below 2^20: equal counts give equal numbers, wherever they stand."""
    whole = counts.astype(np.int64)
    logs = _LOGS[np.minimum(whole, len(_LOGS) - 1)]
    for at in np.argwhere(whole >= len(_LOGS)):
        logs[tuple(at)] = log1p(int(whole[tuple(at)]))
    return np.rint(logs * (weight * STEP))


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> NeighbourModel:
    """Weights and leading singular vectors (by subspace iteration from a fixed start) of the labelled texts' counts, which are overwritten."""
    if not len(labels):
        return NeighbourModel(np.zeros(FEATURES), np.zeros((FEATURES, 1)), np.zeros((0, 1)), labels.astype(np.float64))
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    for start in range(0, len(counts), BATCH_TEXTS):  # in place: this is the driver's largest array; whole numbers below 2^20 are exact in it
        counts[start : start + BATCH_TEXTS] = damped(counts[start : start + BATCH_TEXTS], weight)
    norm = np.sqrt(np.einsum("ij,ij->i", counts, counts, dtype=np.float64))[:, None].astype(np.float32) + np.float32(1e-30)
    basis = np.random.default_rng(11).standard_normal((FEATURES, min(dimensions + 8, FEATURES))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(counts.T @ ((counts @ basis) / norm**2))[0]
    left, scale, right = np.linalg.svd((counts @ basis) / norm, full_matrices=False)
    projection = np.rint((basis @ right.T)[:, :dimensions].astype(np.float64) * GRID)
    model = NeighbourModel(weight, projection, np.zeros((0, 1)), labels.astype(np.float64), neighbours)
    model.vectors = np.concatenate([model.project(counts[s : s + BATCH_TEXTS].astype(np.float64)) for s in range(0, len(counts), BATCH_TEXTS)])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, left_out: int, most: int) -> DataFrame:
    """(text, label): at most `most` labelled rows whose crc32(doc_id) mod `divisor` is not `left_out`, half of them of either label.

    Rows are taken in the order of a hash of their ids, so that a sample is the same each time; a label that has too few leaves its share unused.
    Only labels of documents that are there count towards the share; texts of any length do.
    A document that is repeated, or labelled twice, counts once: its smallest text, and its larger label.
    """
    pick = labels.where(F.col(label).isin(0, 1) & (id_remainder(divisor) != left_out)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label_"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pick = pick.join(texts.select("doc_id"), "doc_id", "left_semi")
    halves = [pick.where(F.col("label_") == v).orderBy(*order).limit(most // 2) for v in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label_").alias("label_"))


def sample_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sample's feature counts, taken on the executors, and labels. Only counts reach the driver: FEATURES numbers a row at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(start, BATCH_TEXTS)
                counts = features(part.column(1).to_pylist())
                at = [np.flatnonzero(c).astype("<u2") for c in counts]
                packed = [a.tobytes() + c[a].astype("<f4").tobytes() for a, c in zip(at, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], names=["doc_id", "label_", "packed"])

    table = sample.mapInArrow(work, "doc_id long, label_ int, packed binary").toArrow().sort_by([("doc_id", "ascending"), ("label_", "ascending")])
    counts = np.zeros((table.num_rows, FEATURES), np.float32)
    for row, packed in enumerate(table.column("packed").to_pylist()):
        many = len(packed) // 6
        counts[row, np.frombuffer(packed, "<u2", many)] = np.frombuffer(packed, "<f4", many, 2 * many)
    return counts, table.column("label_").to_numpy()


def fit_quality(docs: DataFrame, labels: DataFrame, divisor: int = 3, left_out: int = 1, most: int = MAX_LABELLED) -> Broadcast:
    """The model learned from `labels.quality` of at most `most` rows that are not left out, broadcast."""
    model = fit(*sample_counts(labelled_sample(docs, labels, "quality", divisor, left_out, most)))
    give_back()
    return docs.sparkSession.sparkContext.broadcast(model)


def score_column(model: Broadcast, text: Column) -> Column:
    """The score of each text, as a column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.value.score(batch.tolist()))
            give_back()

    return score(text)


def predictions(docs: DataFrame, score: Column, divisor: int, left_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is 0.5 or more) of each row."""
    scored = docs.select("doc_id", (id_remainder(divisor) == left_out).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learns from rows whose crc32(doc_id) mod 3 is not 1.

    Null and empty texts are scored like any other (by their lack of words), texts of any length by all of their features; equal texts get equal scores.
    Repeated rows, and rows with a null doc_id, are scored each. Labels other than 0 and 1, and labels of unknown documents, are left out. Without any
    label every score is 0.5. Empty tables give no rows. Other columns, whatever their names, are left out.
    """
    return predictions(docs, score_column(fit_quality(docs, labels), F.col("text")), 3, 1)
