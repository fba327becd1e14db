"""Language-model scoring with a weighted backoff automaton.

Counts of n-grams over all training texts become states and arcs. A state is a context h that training texts hold; its arc for a word
carries log10 P(word | h), with P(word | h) = (c(h word) + mu P(word | h')) / (c(h) + mu), h' being h without its first word (Dirichlet smoothing with
a mu for each length of h: a proper distribution at every order). A word that never follows h takes the failure arc to h', which carries log10(mu / (c(h) + mu)). At
the root P(word) = (c(word) + 1) / (N + V + 1), for unknown words too. One left-to-right traversal of a text carries the state and
adds up the arcs.

No task holds the whole automaton: each block of documents asks the corpus for the counts of its own n-grams, which gives exactly
the states and arcs that its texts can reach. Words and pairs are asked for first. A longer n-gram need be asked for only if other blocks hold both n-grams
one shorter in it: else no other block holds it, and its count in its own is its count. All counts cover the whole corpus; n-grams are told apart by
hashes of 62 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm import blocks
from terrastack.llm.common import id_remainder

#: Words in the longest n-gram (4 at most), and how many counts the next lower order weighs at contexts of one word, two words and so on (the last holds for longer ones).
ORDER = 3
MU = (2000.0, 5.0)
ROOT = -1
#: Tokens that no word can be: words hold no space.
START, END = b" start", b" end"
_TAG = np.uint64(3)  # the low two bits of a key tell the n-gram's length less one
START_KEY = np.uint64(xxhash.xxh64_intdigest(START) & ~3)
#: Texts that are walked together at least; the last few of a block, which are the longest, are walked one by one.
TOGETHER = 64


def tokens_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts in a row, tokens of each text, a 62-bit hash of each distinct token). A text is a start, its words (A-Z lower-cased, cut at ASCII white space) and an end."""
    array = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(array.cast(pa.large_string()), "")))
    words = lists.flatten()
    kept = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    sizes = np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]) + 2
    coded = words.filter(pa.array(kept)).dictionary_encode()
    hashes = [xxhash.xxh64_intdigest(w) for w in (START, END, *coded.dictionary.to_pylist())]
    ends = np.cumsum(sizes)
    tokens = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    inner = np.ones(len(tokens), bool)
    inner[ends - sizes] = inner[ends - 1] = False
    tokens[ends - 1] = 1
    tokens[inner] = coded.indices.to_numpy() + 2
    return tokens, sizes, np.array(hashes, np.uint64) & ~_TAG


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, of numbers that are not negative: values and places are sorted as one word where both fit in it, which is several times faster."""
    bits = max(1, len(values) - 1).bit_length()
    if not len(values) or int(values.max()) >> (63 - bits):
        return np.unique(values, return_inverse=True)
    packed = np.sort(values << bits | np.arange(len(values)))
    place, ranked = packed & ((1 << bits) - 1), packed >> bits
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    inverse = np.empty(len(values), np.int64)
    inverse[place] = np.cumsum(first) - 1
    return ranked[first], inverse


class BlockGrams:
    """The tokens of a block's texts in a row, and the number of the n-gram that ends at each position.

    Numbers go by length of n-gram: begin[k - 1] is the first of length k. keys are their hashes; prefix and suffix the numbers of the n-grams one shorter (-1 for single
    words). index[k - 1][i] is -1 where the text holds fewer than k tokens up to position i.
    """

    def __init__(self, texts: pa.ChunkedArray, order: int):
        tokens, self.sizes, words = tokens_of(texts)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        position = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.firsts, self.sizes).astype(np.int32)
        self.index, self.begin = [tokens], [0, len(words)]
        keys, none = [words], np.full(len(words), -1, np.int32)
        prefix, suffix = [none], [none]
        for k in range(2, order + 1):
            at = np.flatnonzero(position >= k - 1)
            context = self.index[-1]
            distinct, inverse = numbered((context[at - 1].astype(np.int64) - self.begin[k - 2]) * len(words) + tokens[at])
            before, last = distinct // len(words), distinct % len(words)
            keys.append(blocks.mix(keys[-1][before], words[last]) & ~_TAG | np.uint64(k - 1))
            number = np.full(len(tokens), -1, np.int32)
            number[at] = inverse + self.begin[k - 1]
            prefix.append((before + self.begin[k - 2]).astype(np.int32))
            shorter = np.empty(len(distinct), np.int32)
            shorter[inverse] = context[at]
            suffix.append(shorter)
            self.index.append(number)
            self.begin.append(self.begin[-1] + len(distinct))
        self.keys, self.prefix, self.suffix = np.concatenate(keys), np.concatenate(prefix), np.concatenate(suffix)

    def counts(self, training: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the texts marked `training`."""
        kept = np.repeat(training, self.sizes)
        total = np.zeros(len(self.keys), np.int64)
        for index in self.index:
            total += np.bincount(index[kept & (index >= 0)], minlength=len(self.keys))
        return total

    def asked(self, level: int, shared: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams of `level` words (for 2: of one and two) whose counts the block cannot know, sorted by key.

        `shared` tells which shorter ones other blocks hold too.
        """
        if level == 2:
            some = np.arange(self.begin[min(2, len(self.index))])
        else:
            some = np.arange(self.begin[level - 1], self.begin[level])
            some = some[shared[self.prefix[some]] & shared[self.suffix[some]]]
        return some[np.argsort(self.keys[some])]


def added(keys: np.ndarray, which: np.ndarray, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Entries are twice a count, and one more if several blocks hold the n-gram; so are their sums."""
    counts = np.bincount(which, weights=arrays[0] >> 1, minlength=len(keys)).astype(np.int64)  # exact below 2 ** 53
    several = np.bincount(which, weights=1 + (arrays[0] & 1), minlength=len(keys)) > 1
    return [counts * 2 + several]


def corpus_counts(grams: BlockGrams, own: np.ndarray, answers: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(counts over the corpus of each n-gram up to the length that was asked for last, of longer ones those of the block; whether other blocks hold it)."""
    total, shared = own.copy(), np.zeros(len(own), bool)
    for level, (got,) in enumerate(answers, 2):
        asked = grams.asked(level, shared)
        total[asked], shared[asked] = got >> 1, got & 1
    return total, shared


class BackoffAutomaton:
    """States, arcs and failure arcs over a block's n-grams.

    An n-gram known from training is an arc (from its context, by its last word) and, if shorter than `order`, the state it leads to.
    arc[g] is its weight, goto[g] the state reached, fail[s] and fail_weight[s] the failure arc of state s; a state of one word fails to the root.
    """

    def __init__(self, grams: BlockGrams, count_of: np.ndarray, total: int, distinct: int, order: int, mu: float | tuple[float, ...]):
        by_length = np.array([mu] if isinstance(mu, (int, float)) else mu, np.float64)
        by_length = by_length[np.minimum(np.arange(max(1, order)), len(by_length) - 1)]
        self.order, size = order, len(grams.keys)
        self.known = count_of > 0
        self.level = np.repeat(np.arange(1, order + 1, dtype=np.int8), np.diff(grams.begin))
        chance = np.empty(size)
        single = slice(0, grams.begin[1])
        chance[single] = (count_of[single] + 1) / (total + distinct + 1)
        for k in range(2, order + 1):
            found = slice(grams.begin[k - 1], grams.begin[k])
            shorter, seen = chance[grams.suffix[found]], count_of[grams.prefix[found]]
            chance[found] = np.where(seen > 0, (count_of[found] + by_length[k - 2] * shorter) / (seen + by_length[k - 2]), shorter)
        self.arc = np.log10(chance)
        self.fail = grams.suffix
        own = by_length[np.minimum(self.level, len(by_length)) - 1]  # a state's n-gram is the context
        self.fail_weight = np.log10(own / (count_of + own))
        self.goto = np.where(self.level < order, np.arange(size, dtype=np.int32), grams.suffix)
        #: Where the root goes from each word; unknown words keep it.
        self.root_state = np.where(self.known[single] & (order > 1), np.arange(grams.begin[1], dtype=np.int32), ROOT)

    def walk(self, grams: BlockGrams) -> np.ndarray:
        """log10 probability of each text: all texts of the block advance together, token by token, each with its own state."""
        score = np.zeros(len(grams.sizes))
        longest = np.argsort(-grams.sizes, kind="stable")
        firsts, sizes = grams.firsts[longest], grams.sizes[longest]
        total = np.zeros(len(longest))
        state = self.root_state[grams.index[0][firsts]]
        together = int(sizes[TOGETHER - 1]) if len(sizes) >= TOGETHER else 1
        alive = np.searchsorted(-sizes, -np.arange(1, together), side="left")
        for step, active in enumerate(alive.tolist(), 1):
            at = firsts[:active] + step
            now = state[:active]
            gain = np.zeros(active)
            open_ = np.ones(active, bool)
            onward = np.full(active, ROOT, np.int32)
            for k in range(self.order, 1, -1):
                here = open_ & (now >= 0)
                here &= self.level[now] == k - 1
                if not here.any():
                    continue
                gram = grams.index[k - 1][at]
                taken = here & self.known[gram]
                gain += np.where(taken, self.arc[gram], 0.0)
                onward = np.where(taken, self.goto[gram], onward)
                failed = here & ~taken
                gain += np.where(failed, self.fail_weight[now], 0.0)
                now = np.where(failed, self.fail[now], now)
                open_ &= ~taken
            word = grams.index[0][at]
            gain += np.where(open_, self.arc[word], 0.0)
            state[:active] = np.where(open_, self.root_state[word], onward)
            total[:active] += gain
        for text in range(min(TOGETHER, len(longest))):
            total[text] += self._walk_on(grams, int(firsts[text]), int(sizes[text]), min(together, int(sizes[text])), int(state[text]))
        score[longest] = total
        return score

    def _walk_on(self, grams: BlockGrams, first: int, size: int, step: int, state: int) -> float:
        """The rest of one text's traversal, from token `step` on."""
        if step >= size:
            return 0.0
        own = slice(first + step, first + size)
        here = [index[own] for index in grams.index]
        known, arc, goto = ([x[i].tolist() for i in here] for x in (self.known, self.arc, self.goto))
        root = self.root_state[here[0]].tolist()
        gain = 0.0
        for at in range(size - step):
            while state >= 0:
                k = int(self.level[state])
                if known[k][at]:
                    gain += arc[k][at]
                    state = goto[k][at]
                    break
                gain += float(self.fail_weight[state])
                state = int(self.fail[state])
            else:
                gain += arc[0][at]
                state = root[at]
        return gain


def score_texts(docs: DataFrame, held_out: str, order: int = ORDER, mu: float | tuple[float, ...] = MU, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learns from rows whose `held_out` is false.

    `docs` has doc_id, text and the boolean column `held_out` (null: true); other columns, whatever their names, are left out. Null and empty texts are one
    end token; texts of any length are learned from and scored whole. If nothing trains, N and V are 0 and every score is 0. Repeated rows, and rows
    with a null doc_id, count and are scored each time; equal texts score alike up to the last digits; there are no ties to break, since every n-gram counts. Empty tables give no rows.
    """
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    blocked, many = blocks.deal(docs.select("doc_id", "text", F.coalesce(F.col(held_out), F.lit(True)).alias("held_out")), block_bytes)

    def merge(keys: np.ndarray, which: np.ndarray, arrays: list[np.ndarray]) -> tuple[list[np.ndarray], tuple[int, int]]:
        (sums,) = added(keys, which, arrays)
        counts = sums[(keys & _TAG == 0) & (keys != START_KEY)] >> 1
        return [sums], (int(counts.sum()), int((counts > 0).sum()))

    def questions(rows: pa.Table, answers: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        level = len(answers) + 2
        grams = BlockGrams(rows.column("text"), min(order, level))
        own = grams.counts(_training(rows))
        asked = grams.asked(level, corpus_counts(grams, own, answers)[1])
        return grams.keys[asked], [own[asked] * 2]

    lookup = blocks.Lookup(many, ["<i8"], ["<i8"], merge, added)
    first, sums = lookup.answers(blocks.first_questions(blocked, lambda rows: questions(rows, []), lookup))
    heard = [(lookup, first)]
    for _ in range(3, order + 1):
        more = blocks.with_answers(blocked, heard, lambda block, rows, answers: lookup.ask(block, *questions(rows, answers)), lookup.asked)
        heard.append((lookup, lookup.answers(more)[0]))
    total, distinct = (int(x or 0) for x in sums.agg(F.sum("s0"), F.sum("s1")).first())

    def work(block: int, rows: pa.Table, answers: list[list[np.ndarray]]) -> pa.Table:
        grams = BlockGrams(rows.column("text"), order)
        automaton = BackoffAutomaton(grams, corpus_counts(grams, grams.counts(_training(rows)), answers)[0], total, distinct, order, mu)
        words = grams.index[0]
        starts = np.zeros(len(words), bool)
        starts[grams.firsts] = True
        found = {
            "n_tokens": grams.sizes - 1,
            "n_known": np.add.reduceat(np.where(starts, 0, automaton.known[words]), grams.firsts),
            "train_tokens": np.full(rows.num_rows, total, np.int64),
            "base_score": np.add.reduceat(np.where(starts, 0.0, automaton.arc[words]), grams.firsts),
            "score": automaton.walk(grams),
        }
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), **found})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.with_answers(blocked, heard, work, schema)


def _training(rows: pa.Table) -> np.ndarray:
    return ~rows.column("held_out").to_numpy().astype(bool)


def score_documents(docs: DataFrame, order: int = ORDER, mu: float | tuple[float, ...] = MU) -> DataFrame:
    """Scores all of `docs`, holding out rows whose crc32(doc_id as text) mod 7 is 2. What score_texts says of odd rows holds."""
    return score_texts(docs.select("doc_id", "text", (id_remainder(7) == 2).alias("held_out")), "held_out", order, mu)
