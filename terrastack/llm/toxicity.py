"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its letter n-grams (hashed) and of itself; a bag of words is the mean of its words; a softmax over a linear map
of that mean gives the bag's chance of being toxic, and a text's score is that of the bag of its WORST words (fewer in short texts), so that a few words in a
long text count and a single odd word of clean text does not. Embeddings and map are trained jointly in numpy. A misspelt word that training never
saw shares most of its n-grams with the word it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.llm.common import give_back
from terrastack.llm.quality import labelled_sample, predictions

#: Labelled rows that a model is fitted on at most, half of either label.
MAX_LABELLED = 3000
BUCKETS, DIMENSIONS = 1 << 16, 12
SIZES = (3, 4, 5)
#: Words (occurrences) of a text that its score is taken over at most, and words of the text for each of them.
WORST, WORDS_EACH = 3, 10
EPOCHS, WARM_UP, RATE = 50, 5, 0.05
UNKNOWN, DECAY = 0.3, 1e-6
#: Words whose logits are kept at most, and their letters: longer ones are worked out each time. Words of more than LONG_WORD letters are hashed in slices of so many.
CACHED_WORDS, CACHED_LETTERS, LONG_WORD = 150_000, 64, 1 << 16
_POWER = 0x9E3779B97F4A7C15
EDGES = ".,;:!?\"'()[]{}|#*$%&<>-_/\\"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare_word(word: str) -> str:
    """A word between marks of its ends, stripped of marks at its edges."""
    return f"<{word.strip(EDGES) or word}>"


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def long_subwords(word: str) -> Iterator[np.ndarray]:
    """Buckets of one word's n-grams and, last, of itself, as subwords() has them, a slice of the word at a time."""
    bare, whole = bare_word(word), 0
    for start in range(0, len(bare), LONG_WORD):
        codes = np.frombuffer(bare[start : start + LONG_WORD + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        here = min(LONG_WORD, len(bare) - start)
        rolled = np.zeros(len(codes), np.uint64)
        for n in range(1, max(SIZES) + 1):
            many = max(0, len(codes) - n + 1)
            rolled[:many] = rolled[:many] * np.uint64(0x100000001B3) ^ codes[n - 1 :]
            if n in SIZES:
                yield _bucket(rolled[: min(many, here)] + np.uint64(n))
        power = np.cumprod(np.full(here, np.uint64(_POWER)))
        whole += int((codes[:here] * power).sum(dtype=np.uint64)) * pow(_POWER, start, 1 << 64)
    yield _bucket(np.array([whole % (1 << 64)], np.uint64))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first) : the hashed n-grams of each word in turn, and where each word's begin. Words are stripped of marks at their edges."""
    bare = [bare_word(w) for w in words]
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(bare)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    owners, hashes = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        many = max(0, len(codes) - n + 1)  # few short words may have fewer letters in all than an n-gram
        rolled[:many] = rolled[:many] * np.uint64(0x100000001B3) ^ codes[n - 1 :]
        if n in SIZES:
            whole = left >= n
            owners.append(owner[whole])
            hashes.append(rolled[whole] + np.uint64(n))
    power = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 1, np.uint64(_POWER)))
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    owners.append(np.arange(len(bare)))
    hashes.append(np.add.reduceat(codes * power[place], ends - sizes) if len(bare) else np.empty(0, np.uint64))
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    buckets = _bucket(hashes)[order]
    many = np.bincount(owners, minlength=len(bare))
    return buckets, np.cumsum(many) - many


def in_parts(words: list[str], letters: int = 200_000) -> Iterator[list[str]]:
    """The words in turn, about `letters` of them at a time; a word of more than LONG_WORD letters comes alone."""
    part, held = [], 0
    for word in words:
        if part and (held + len(word) > letters or len(word) > LONG_WORD):
            yield part
            part, held = [], 0
        part.append(word)
        held += len(word) + 2
        if len(word) > LONG_WORD:
            yield part
            part, held = [], 0
    if part:
        yield part


def subwords_in_parts(words: list[str], letters: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """As subwords, some words at a time; buckets take four bytes, and there are about three for each letter."""
    found, first, before = [], [], 0
    for part in in_parts(words, letters):
        if len(part[0]) > LONG_WORD:
            buckets, starts = np.concatenate([b.astype(np.int32) for b in long_subwords(part[0])]), np.zeros(1, np.int64)
        else:
            buckets, starts = subwords(part)
        found.append(buckets.astype(np.int32))
        first.append(starts + before)
        before += len(buckets)
    return np.concatenate(found), np.concatenate(first)


def worst_counts(sizes: np.ndarray) -> np.ndarray:
    """How many words of texts of `sizes` words count: one in WORDS_EACH, but one at least and WORST at most."""
    return np.clip(sizes // WORDS_EACH, 1, WORST)


def worst_words(values: np.ndarray, count: np.ndarray, owner: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How often each distinct word of each text is among the text's `most` worst: by value, then place. `start` is where a text's words begin; WORST rounds, no sorting."""
    taken, left, values = np.zeros(len(values), np.int64), most.copy(), values.copy()
    for _ in range(int(most.max())):
        top = np.maximum.reduceat(values, start)
        at = np.flatnonzero(values == top[owner])
        at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]  # the first of each text's largest
        text = owner[at]
        taken[at] += np.minimum(count[at], left[text]) * (left[text] > 0) * (values[at] > -np.inf)
        left[text] -= np.minimum(count[at], left[text])
        values[at] = -np.inf
    return taken


def worst_means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of each text's largest values, as many as worst_counts says; 0 for a text without words."""
    ends, counts = np.cumsum(sizes), worst_counts(sizes)
    out = np.zeros(len(sizes))
    for i in np.flatnonzero(sizes):
        own = values[ends[i] - sizes[i] : ends[i]]
        out[i] = (np.partition(own, len(own) - counts[i])[-counts[i] :] if len(own) > counts[i] else own).mean()
    return out


@dataclass
class SubwordModel:
    """Embeddings of the buckets, and the linear map to the logits of the two labels."""

    embeddings: np.ndarray
    linear: np.ndarray
    bias: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"embeddings": self.embeddings, "linear": self.linear, "bias": self.bias, "known": {}}

    @property
    def taught(self) -> bool:
        """Whether there were examples of both labels: without, all embeddings are zero."""
        return bool(self.embeddings.any())

    def word_logits(self, words: list[str]) -> np.ndarray:
        """Difference of the two logits of each word by itself, without the bias: averages of these are bags' differences."""
        by_bucket = (self.embeddings @ (self.linear[:, 1] - self.linear[:, 0])).astype(np.float64)
        found = [np.empty(0)]
        for part in in_parts(words):
            if len(part[0]) > LONG_WORD:
                sums = [(by_bucket[b].sum(), len(b)) for b in long_subwords(part[0])]
                found.append(np.array([sum(s for s, _ in sums) / sum(n for _, n in sums)]))
            else:
                buckets, first = subwords(part)
                found.append(np.add.reduceat(by_bucket[buckets], first) / np.diff([*first, len(buckets)]))
        return np.concatenate(found)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Softmax chance of label 1 of the bag of each text's worst words; a text without words has the bias alone."""
        parts = [words_of(t) for t in texts]
        fresh = list({w for p in parts for w in p if w not in self.known})
        if len(self.known) + len(fresh) > CACHED_WORDS:
            self.known.clear()
            fresh = list({w for p in parts for w in p})
        long = [w for w in fresh if len(w) > CACHED_LETTERS]
        fresh = [w for w in fresh if len(w) <= CACHED_LETTERS]
        self.known.update(zip(fresh, self.word_logits(fresh).tolist(), strict=True))
        here = dict(zip(long, self.word_logits(long).tolist(), strict=True))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        value = (lambda w: self.known[w] if len(w) <= CACHED_LETTERS else here[w]) if here else self.known.__getitem__
        values = np.fromiter((value(w) for p in parts for w in p), np.float64, int(sizes.sum()))
        worst = worst_means(values, sizes)
        return 1 / (1 + np.exp(-np.clip(worst + (self.bias[1] - self.bias[0]), -60, 60)))


#: All that training needs of a text, whatever its length: its distinct words, and how often each occurs.
Example = tuple[list[str], np.ndarray]


def example(text: str | None) -> Example:
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
    return list(numbers), np.bincount(ids, minlength=len(numbers))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> SubwordModel:
    """As train_examples, from texts."""
    return train_examples([example(t) for t in texts], labels, epochs, seed)


def train_examples(examples: list[Example], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> SubwordModel:
    """Embeddings and softmax by Adam on whole batches: first on the means of whole texts, then on each text's worst words.

    Both labels weigh the same. One more example, of label 0 and weight UNKNOWN, is a bag of n-grams that training never saw: their embeddings
    stay zero. Without examples of both labels, every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    embeddings = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    linear = (rng.standard_normal((DIMENSIONS, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2)
    labels = np.asarray(labels, np.int64)[[i for i, e in enumerate(examples) if e[0]]]
    examples = [e for e in examples if e[0]]
    if len(set(labels.tolist())) < 2:
        return SubwordModel(embeddings, linear, bias)
    numbers: dict[str, int] = {}
    ids = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32) for words, _ in examples]
    bag, bag_owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    count = np.concatenate([own for _, own in examples]).astype(np.int64)
    start = np.searchsorted(bag_owner, np.arange(len(ids)))
    size = np.add.reduceat(count, start)
    buckets, first = subwords_in_parts(list(numbers))
    many = np.diff([*first, len(buckets)])
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    state = [np.zeros_like(x) for x in (embeddings, embeddings, linear, linear, bias, bias)]
    for epoch in range(1, epochs + 1):
        if epoch <= WARM_UP:
            chosen, owner, weight = bag, bag_owner, count / size[bag_owner]
        else:
            each = (embeddings @ (linear[:, 1] - linear[:, 0])).astype(np.float64)[buckets]
            word = np.add.reduceat(each, first) / many
            most = worst_counts(size)
            taken = worst_words(word[bag], count, bag_owner, start, most)
            kept = taken > 0
            chosen, owner = bag[kept], bag_owner[kept]
            weight = taken[kept] / most[owner]
        # word vectors of the chosen words only, then their weighted sums over each text (or its worst words)
        used, which = np.unique(chosen, return_inverse=True)
        span = many[used]
        flat = buckets if len(used) == len(many) else buckets[np.repeat(first[used], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)]
        begins = np.cumsum(span) - span
        vectors = np.stack([np.add.reduceat(embeddings[:, d][flat], begins) for d in range(DIMENSIONS)], 1) / span[:, None]  # a dimension at a time: the whole would be large
        hidden = np.stack([np.bincount(owner, weights=vectors[which, d] * weight, minlength=len(labels)) for d in range(DIMENSIONS)], 1)
        logits = hidden @ linear + bias
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        error = chance.copy()
        error[np.arange(len(labels)), labels] -= 1
        error *= share[:, None]
        back = error @ linear.T
        by_word = np.stack([np.bincount(which, weights=back[owner, d] * weight, minlength=len(used)) for d in range(DIMENSIONS)], 1) / span[:, None]
        slope = np.stack([np.bincount(flat, weights=np.repeat(by_word[:, d], span), minlength=BUCKETS) for d in range(DIMENSIONS)], 1)
        slope += DECAY * embeddings
        unseen = np.exp(bias - np.logaddexp(*bias)) - [1, 0]
        slopes = (slope, hidden.T @ error + 1e-4 * linear, error.sum(0) + UNKNOWN * unseen)
        for i, (value, g) in enumerate(zip((embeddings, linear, bias), slopes, strict=True)):
            m, v = state[2 * i], state[2 * i + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value -= (RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)).astype(value.dtype)
    return SubwordModel(embeddings, linear, bias)


def sample_examples(sample: DataFrame) -> tuple[list[Example], np.ndarray]:
    """The sample's Examples, made on the executors, and labels: of a text only its distinct words and their counts reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                words, count = example(part.column(1)[0].as_py())
                packed = pa.array([words], pa.list_(pa.string())), pa.array([count.astype("<i4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *packed], names=["doc_id", "label_", "words", "count"])

    table = sample.mapInArrow(work, "doc_id long, label_ int, words array<string>, count binary").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("label_", "ascending")])
    found: list[Example] = []
    words: dict[str, str] = {}  # one string for each distinct word, not one for each text that has it
    for row in range(table.num_rows):
        own = [words.setdefault(w, w) for w in table.column("words")[row].as_py()]
        found.append((own, np.frombuffer(table.column("count")[row].as_py(), "<i4")))
    return found, table.column("label_").to_numpy().astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, divisor: int = 5, left_out: int = 0, most: int = MAX_LABELLED) -> Broadcast:
    """The model learned from `labels.toxic` of at most `most` rows, of any length, that are not left out, broadcast."""
    examples, wanted = sample_examples(labelled_sample(docs, labels, "toxic", divisor, left_out, most))
    give_back()
    model = train_examples(examples, wanted)
    del examples
    give_back()
    return docs.sparkSession.sparkContext.broadcast(model)


def score_column(model: Broadcast, text: Column) -> Column:
    """The score of each text, as a column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([np.empty(0), *(model.value.score(texts[i : i + 128]) for i in range(0, len(texts), 128))]))
            give_back()

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learns from rows whose crc32(doc_id) mod 5 is not 0.

    Null and empty texts have no words and score what the bias gives; texts of any length, and words of any length, are scored (and learned from) whole; equal texts get equal
    scores; of equally bad words it doesn't matter which counts, and a score of just 0.5 is predicted 1. Repeated rows, and rows with a null doc_id, are scored each. Labels other than 0 and 1, and labels of unknown documents, are left out. Without
    examples of both labels every score is 0.5. Empty tables give no rows. Other columns, whatever their names, are left out.
    """
    return predictions(docs, score_column(fit_toxicity(docs, labels), F.col("text")), 5, 0)
