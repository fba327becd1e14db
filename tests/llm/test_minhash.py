import hashlib
import random
import re
import string

import numpy as np
import pytest
import xxhash

from terrastack.llm import minhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def follow(rows):
    rows = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(2**63), r[1] or ""))
    return [(*r, rows[(i + 1) % len(rows)][1] or "") for i, r in enumerate(rows)]


@pytest.mark.parametrize("size", [300, 10**9])
def test_rows_equal_the_contract(spark, monkeypatch, size):
    monkeypatch.setattr(minhash, "RANGE_BYTES", size)
    monkeypatch.setattr(minhash, "LEAVES", 8)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["aé", "B", "cc", "☃", "𝒳d", "e", "f", "g"], k=rng.randint(0, 300))) for _ in range(40)] + [None, "", " x ", "same text", "same text"]
    ids = [rng.randrange(10**6) for _ in texts]
    ids[3], ids[4], ids[5] = None, 77, 77
    rows = list(zip(ids, texts, ["z"] * len(ids), strict=True))
    got = minhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, bins string")).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text, _, after in follow(rows):
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    prints = {}
    for r, (doc_id, text, *_rest) in zip(sorted(got, key=lambda r: r.edited_sha256), sorted(follow(rows), key=lambda r: hashlib.sha256(((r[1] or "")[: len(r[1] or "") - len(r[1] or "") // 2] + r[3][: len(r[1] or "") // 2]).encode()).hexdigest()), strict=True):
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 2 * minhash.BINS
        assert prints.setdefault(text or "", r.fingerprint) == r.fingerprint


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(8)
    rows, want = [], []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 12, 30, 100, 400, 1500]))]
        keep = rng.random()
        other = words[: int(len(words) * keep)] + [f"v{rng.randrange(5000)}" for _ in range(int(len(words) * (1 - keep)))]
        rows.append((i, " ".join(words), " ".join(other)))
        want.append(jaccard(rows[-1][1], rows[-1][2]))
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string")
    both = minhash.with_fingerprints(minhash.with_fingerprints(docs, "a", "x"), "b", "y")
    got = {r.doc_id: r.n for r in both.select("doc_id", minhash.likeness(both.x, both.y).alias("n")).collect()}
    errors = [got[i] - w for i, w in enumerate(want)]
    big = [e for e, r in zip(errors, rows, strict=True) if len(r[1].split()) >= 30]
    assert abs(sum(errors) / len(errors)) < 0.03
    assert max(map(abs, big)) < 0.15


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = minhash.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    only = minhash.edited_fingerprints(spark.createDataFrame([(5, "one two three four")], schema)).first()
    assert only.edited_sha256 == hashlib.sha256(b"one two tone two t").hexdigest()
    assert only.near_next == 1.0


def spark_hash(*values):
    """What F.xxhash64 gives: each value (text, 64-bit or 32-bit number) hashed with the hash before it as seed; nulls are passed over."""
    seed = 42
    for kind, value in values:
        raw = value.encode() if kind == "s" else value.to_bytes(8 if kind == "l" else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_fingerprint(text):
    """Bins, densification and low-order bits written out with dictionaries."""
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    words = [("l", spark_hash(("s", w))) for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    hashes = [spark_hash(*words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    least = {}
    for h in hashes:
        least[(h >> 56) + 128] = min(h, least.get((h >> 56) + 128, h))
    draws = np.random.default_rng(97).integers(0, minhash.BINS, (minhash.DRAWS, minhash.BINS))
    out = []
    for i in range(minhash.BINS):
        places = [i, *draws[:, i].tolist()]
        value = next((least[p] for p in places if p in least), None)
        if value is None:
            value = min(((spark_hash(("i", i), ("i", j)), v) for j, v in least.items()), default=(0, 0))[1]
        out.append(value & 255)
    return out


def brute_likeness(a, b):
    equal = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return min(1.0, max(0.0, (equal - 1 / 256) / (1 - 1 / 256)))


def test_fingerprints_and_likeness_equal_brute_force(spark):
    rng = random.Random(17)
    words = ["Alpha", "beta", "Été", "x.", "gamma", *map(str, range(40))]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 6, 30, 300, 3000]))) for _ in range(24)] + [None, "", " \n", "same words here", "same words here"]
    docs = spark.createDataFrame([(5 * i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, bins string")
    got = {r.doc_id: r for r in minhash.edited_fingerprints(docs).collect()}
    own = [brute_fingerprint(t) for t in texts]
    for i, text in enumerate(texts):
        text, after = text or "", (i + 1) % len(texts)
        half = len(text) // 2
        edited = brute_fingerprint(text[: len(text) - half] + (texts[after] or "")[:half])
        r = got[5 * i]
        assert r.fingerprint == bytes(own[i]).hex() and r.edited_fingerprint == bytes(edited).hex()
        assert r.near_edited == pytest.approx(brute_likeness(own[i], edited)) and r.near_next == pytest.approx(brute_likeness(own[i], own[after]))


def test_very_long_text(spark):
    long = " ".join(f"w{i % 7919}" for i in range(150_000))
    got = {r.doc_id: r for r in minhash.edited_fingerprints(spark.createDataFrame([(1, long), (2, long), (None, "a b")], "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint == bytes(brute_fingerprint(long)).hex() and got[1].n_chars == len(long)
