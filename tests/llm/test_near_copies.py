import random
import time

import corpus_pipeline
import numpy as np
import pytest

from terrastack.llm import near_copies


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts, likeness=0.8):
    """Numbers of the texts that stay: the smallest of each component."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= likeness:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_go_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "QUERY_BLOCK", block)
    monkeypatch.setattr(near_copies, "RANGE_BYTES", 20_000)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    stock = " ".join(rng.choices(vocabulary, k=12))
    texts = ["", None, "one two", "One  two", "one two three"]
    for n in range(60):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(" ".join([*words, stock] if n % 2 else words))
        for edits in range(rng.randint(0, 3)):
            other = list(words)
            for _ in range(1 + edits * len(words) // 60):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    wanted = brute_kept(texts)
    assert kept == wanted and len(wanted) < len(set(texts)) - 20


def test_parity_fingerprints_miss_nothing():
    """Sets of likeness 0.8 are near by parity, whatever their sizes, and sizes of a pair have one kind of fingerprint in common."""
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, near_copies.SHORT + 1))
        both = np.unique(rng.integers(0, 1 << 63, n + 30, dtype=np.uint64))
        shared = int(rng.integers(0, n + 1))
        a, b = np.sort(both[:n]), np.sort(np.concatenate((both[:shared], both[n : n + int(rng.integers(0, 14))])))
        if not len(b) or len(b) > near_copies.SHORT or near_copies.likeness(a, b) < 0.8 - 1e-12:
            continue
        rows = [near_copies.entries_of(i, x, np.empty(0, np.uint64))[:1] for i, x in enumerate((a, b))]
        assert near_copies.near(rows[0], rows[1]).all()
        assert np.bitwise_count(rows[0]["print"] ^ rows[1]["print"]).sum() <= len(a) // 4  # the radius of the search
    assert all(m <= near_copies.SHORT or n > near_copies.SHORT_FROM for n in range(1, 100) for m in range(n, 5 * n // 4 + 1))


def template_texts(many, seed=2):
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for n in range(many):
        words = list(base)
        for place in rng.sample(range(200), 3):
            words[place] = f"own{n}x{place}"
        texts.append(" ".join(words))
    return texts


def test_template_texts_in_proportion_to_their_number():
    """Texts of one template meet a leader each, not each other."""
    times = {}
    for many in (1000, 4000):
        entries = np.concatenate([near_copies.entries_of(i, near_copies.shingles(near_copies.words_of(t)), np.empty(0, np.uint64)) for i, t in enumerate(template_texts(many))])
        began = time.process_time()
        a, b = near_copies.shard_links(entries)
        times[many] = time.process_time() - began
        assert set(b.tolist()) == {0} and len(a) == many - 1
    assert times[4000] < 8 * times[1000] + 0.5


@pytest.mark.parametrize("hot", [True, False])
def test_hot_shards_lose_no_link(spark, monkeypatch, hot):
    """Half of all texts share a stock passage that makes up most of them, in several groups; leaders from a sample or within shards, few askers in a task."""
    monkeypatch.setattr(near_copies, "LED", 8 if hot else 1 << 30)
    monkeypatch.setattr(near_copies, "QUERY_BLOCK", 7)
    monkeypatch.setattr(near_copies, "SEARCHED", 16)
    rng = random.Random(5)
    stock = [f"s{i}" for i in range(40)]
    texts = [" ".join(stock + [f"g{g}w{i}" for i in range(16 + g % 5)]) for g in range(25)]
    for t in list(texts):
        for _ in range(3):
            words = t.split()
            words[rng.randrange(len(words))] = f"x{rng.random()}"
            texts.append(" ".join(words))
    texts += [" ".join(f"u{rng.randrange(3000)}" for _ in range(rng.randint(5, 80))) for _ in range(60)] + template_texts(40)
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if hot:
        assert len(near_copies.common_shingles(docs, len(texts))[1]) > 10
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == brute_kept(texts)


@pytest.mark.parametrize("words", [9, 10, 14, 24, 40, 60, 120, 450])
def test_recall_at_every_length(words):
    """Pairs of likeness 0.8 to 0.85 by their candidates: fingerprints within reach of each other in a shard that both have."""
    rng = random.Random(words)
    tried = found = 0
    for _ in range(20_000):
        if tried == 300:
            break
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        other = list(text)
        cut = rng.randrange(1, words // 5 + 2)
        other = other[:-cut] if rng.random() < 0.5 else other + [f"n{i}" for i in range(cut)]
        if words > 40 and rng.random() < 0.5:
            other[rng.randrange(len(other))] = "y"
        sets = [near_copies.shingles([w.encode() for w in x]) for x in (text, other)]
        if not 0.8 <= near_copies.likeness(*sets) < 0.86:
            continue
        tried += 1
        a, b = near_copies.shard_links(np.concatenate([near_copies.entries_of(i, s, np.empty(0, np.uint64)) for i, s in enumerate(sets)]))
        found += len(a)
    assert tried == 300 and found >= (0.99 if words > 60 else 1) * tried
