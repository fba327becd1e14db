import random

import numpy as np
import pytest
import xxhash

from terrastack.llm import simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_masks_keep_every_link():
    masks = simhash.band_masks()
    pairs = [(i, j) for i in range(64) for j in range(i)] + [(i, i) for i in range(64)]
    for i, j in pairs:
        change = (1 << i) | (1 << j)
        assert any(m & change == 0 for m in masks)


@pytest.mark.parametrize("seed", range(3))
def test_tree_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 6)).astype(np.uint64)
    words = np.unique(np.concatenate([base, *(base ^ flips[:, i] for i in range(3)), base ^ flips[:, 3] ^ flips[:, 4]]))
    at, node = simhash.BKTree(words).search(words, 2)
    found = sorted(zip(at.tolist(), node.tolist(), strict=True))
    wanted = sorted((i, j) for i in range(len(words)) for j in range(len(words)) if bin(int(words[i] ^ words[j])).count("1") <= 2)
    assert found == wanted


def test_rows_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", None, " \t", "One", "one", "one two", "É a b c"] + texts[:6]
    ids = [3 * i + 7 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t or "") for t in texts]
    roots = brute_components(prints)
    assert len(got) == len(ids)
    for i, doc_id in enumerate(ids):
        assert got[doc_id].fingerprint == f"{prints[i]:016x}"
        assert got[doc_id].component_id == min(ids[j] for j in range(len(ids)) if roots[j] == roots[i])
    assert len(set(roots)) < len(roots)


@pytest.mark.parametrize(("hot", "most"), [(4096, 1 << 19), (8, 1 << 19), (8, 20)], ids=["one task", "broadcast", "cut further"])
def test_links_join_the_groups_of_brute_force(spark, monkeypatch, hot, most):
    """However hot shards are searched, the components are those of all pairs."""
    monkeypatch.setattr(simhash, "HOT_WORDS", hot)
    monkeypatch.setattr(simhash, "BROADCAST_WORDS", most)
    rng = random.Random(3)
    words = {0xABCD << 40 | i for i in range(60)}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(6):
            words.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    words = sorted(words)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    links = simhash.fingerprint_links(spark.createDataFrame([(w,) for w in signed], "fp long"))
    root = {r.node: r.root for r in simhash.components(links).collect()}
    brute = brute_components(words)
    groups, got = {}, {}
    for i, w in enumerate(signed):
        groups.setdefault(brute[i], set()).add(w)
        got.setdefault(root.get(w, w), set()).add(w)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values())) and len(groups) < len(words) - 40


def test_further_masks_keep_every_link():
    for mask in simhash.band_masks():
        rest = [b for b in range(64) if not mask >> b & 1]
        further = simhash.further_masks(mask)
        assert all(m & mask == mask and 64 - bin(m).count("1") <= 14 for m in further)
        assert all(any(m & (1 << i | 1 << j) == 0 for m in further) for i in rest for j in rest)


def test_trees_of_many_shards_and_wide_fingerprints():
    rng = np.random.default_rng(4)
    shard = np.repeat(np.arange(30), rng.integers(1, 12, 30))
    words = rng.integers(0, 1 << 63, (len(shard), 2), dtype=np.uint64)
    words[5:9] = words[4]
    tree = simhash.BKTree(words, shard)
    found = [(a, n) for at, node in tree.found(words, 60, tree.root, 7) for a, n in zip(at.tolist(), node.tolist(), strict=True)]
    apart = lambda i, j: sum(bin(int(words[i, k] ^ words[j, k])).count("1") for k in (0, 1))
    assert sorted(found) == [(i, j) for i in range(len(shard)) for j in range(len(shard)) if shard[i] == shard[j] and apart(i, j) <= 60]


def test_long_texts_and_hot_fingerprints(spark):
    """A third of all rows are copies; a very long text and its edited copy are linked, whatever columns come along."""
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    rows = [(i, "the same few words", 0) for i in range(40)] + [(100 + i, " ".join(f"x{rng.random()}" for _ in range(9)), 0) for i in range(80)]
    rows += [(900, " ".join(long), 1), (901, " ".join([*long, "end"]), 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()}
    assert {got[i] for i in range(40)} == {0} and got[900] == got[901] == 900 and all(got[100 + i] == 100 + i for i in range(80))


def test_chain_of_links_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(links).collect()} == {(i, 0) for i in range(1, 71)}


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], schema)).collect()
    assert [r.component_id for r in rows] == [4, 4, 4]
