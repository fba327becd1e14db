import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from terrastack.llm import blocks, ngram_lm


def brute(texts, held, order, mu):
    """Scores by plain dictionaries and the smoothing formula itself."""
    sequences = [["<s>"] + [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for t in texts]
    grams = Counter()
    for s, h in zip(sequences, held, strict=True):
        if not h:
            for k in range(1, order + 1):
                grams.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    single = {g[0]: n for g, n in grams.items() if len(g) == 1 and g[0] != "<s>"}
    total, distinct = sum(single.values()), len(single)

    def chance(context, word):
        if not context:
            return (single.get(word, 0) + 1) / (total + distinct + 1)
        lower = chance(context[1:], word)
        seen = grams[context]
        return (grams[(*context, word)] + mu * lower) / (seen + mu) if seen else lower

    rows = []
    for s in sequences:
        words = s[1:]
        base = sum(math.log10((single.get(w, 0) + 1) / (total + distinct + 1)) for w in words)
        score = sum(math.log10(chance(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        rows.append((len(words), sum(w in single for w in words), total, base, score))
    return rows


@pytest.mark.parametrize(("order", "mu", "block"), [(1, 1.0, 10**6), (2, 300.0, 400), (3, 5.0, 700), (4, 2.0, 10**6)])
@pytest.mark.parametrize("fan", [1024, 2])
def test_scores_equal_brute_force(spark, monkeypatch, order, mu, block, fan):
    monkeypatch.setattr(blocks, "FAN", fan)  # 2: blocks are gathered and sent on in two levels
    monkeypatch.setattr(ngram_lm, "TOGETHER", fan)
    rng = random.Random(order)
    words = ["The", "the", "cat", "É", "dog", "sat.", "on", "x y", "start", "end"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(40)] + ["", None, " \t\n", "The cat", "The cat", "new words here"]
    ids = [*range(len(texts) - 1), 0]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, score string")
    got = ngram_lm.score_texts(docs.selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 7 = 2 as h"), "h", order, mu, block).collect()
    want = brute(texts, held, order, mu)
    key = lambda r: (r[0], r[1], r[2], round(r[5], 6))
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    need = sorted(((i, n, k, h, t, b, s) for i, h, (n, k, t, b, s) in zip(ids, held, want, strict=True)), key=key)
    assert len(have) == len(need)
    for a, b in zip(have, need, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-9) and a[6] == pytest.approx(b[6], abs=1e-9)


def test_unknown_words_pay_the_root(spark):
    """After an unknown word the state is the root: a second unknown word adds log10(1 / (N + V + 1)) and nothing else."""
    rows = [(0, "a b", False), (1, "a c", False), (2, "b a a", False), (3, "unknown", True), (4, "unknown unknown", True)]
    got = {r.doc_id: r.score for r in ngram_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), "h", 2, 3.0).collect()}
    assert got[4] - got[3] == pytest.approx(math.log10(1 / (10 + 4 + 1)), abs=1e-9)


def test_empty_table_and_nothing_to_learn(spark):
    schema = "doc_id long, text string, h boolean"
    assert ngram_lm.score_texts(spark.createDataFrame([], schema), "h").collect() == []
    rows = ngram_lm.score_texts(spark.createDataFrame([(1, "a b", True), (None, None, None)], schema), "h").collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows} == {(1, 3, 0, 0, 0.0), (None, 1, 0, 0, 0.0)}


def test_registered_model_learns_trigrams(spark):
    """Of two contexts that differ only in their first word, the shipped order tells what follows; each length has its own mu."""
    rows = [(i, "a b c", False) for i in range(30)] + [(30 + i, "d b e", False) for i in range(30)] + [(60, "a b c", True), (61, "d b c", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in ngram_lm.score_texts(docs, "h").collect()}
    assert got[60] - got[61] > 0.5
    both = {r.doc_id: r.score for r in ngram_lm.score_texts(docs, "h", 3, (7.0, 2.0)).collect()}
    single = lambda n: (n + 1) / (240 + 6 + 1)
    two = lambda c, n, w: (c + 7 * single(w)) / (n + 7)
    chances = [two(30, 60, 30), (30 + 2 * two(60 / 2, 30, 60)) / 32, (30 + 2 * two(30, 60, 30)) / 32, (30 + 2 * two(30, 30, 60)) / 32]
    assert both[60] == pytest.approx(sum(map(math.log10, chances)), abs=1e-9)


@pytest.mark.parametrize(("many", "high"), [(0, 1), (1, 5), (1000, 7), (1000, 2**40), (1000, 2**62)])
def test_numbered_equals_unique(many, high):
    values = np.random.default_rng(1).integers(0, high, many)
    for got, want in zip(ngram_lm.numbered(values), np.unique(values, return_inverse=True), strict=True):
        assert (got == want).all()


def test_long_texts_and_hot_words(spark):
    """A text of 60,000 words, and a word that fills a third of all texts: all of it is counted and scored, in blocks far smaller than the text."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["hot", "hot", *map(str, range(50))], k=60_000))] + ["hot " * rng.randint(1, 60) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id long, text string, h boolean")
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs, "h", 3, (300.0, 5.0), 3000).collect()}
    wide = {r.doc_id: r for r in ngram_lm.score_texts(docs, "h", 3, (300.0, 5.0)).collect()}
    assert got[0].n_tokens == 60_001 and len(got) == len(texts)
    assert all(got[i].score == pytest.approx(wide[i].score, abs=1e-6) and got[i].train_tokens == wide[i].train_tokens for i in got)


def test_many_equal_rows_count_each_and_score_alike(spark):
    """Half of all rows are one row without an id, dealt to all blocks."""
    rows = [(None, "the same words again and again", False)] * 800 + [(i, f"other words {i % 90} in a text of {i % 7}", i % 5 == 0) for i in range(800)]
    found = ngram_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), "held", block_bytes=20_000).collect()
    assert len(found) == len(rows)
    assert {r.train_tokens for r in found} == {sum(len(t.split()) + 1 for _, t, held in rows if not held)}
    scores = [r.score for r in found if r.doc_id is None]
    assert len(scores) == 800 and max(scores) - min(scores) < 1e-9
