import hashlib
import os
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrastack.llm import periodic_runs, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, runs int, period string"


def brute(words, min_words=6, min_repeats=4):
    """Every run, by trying every period at every place."""
    found, many = [], len(words)
    for q in range(1, many // min_repeats + 1):
        i = 0
        while i + q < many:
            j = i
            while j + q < many and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_words, min_repeats * q):
                own = words[i : i + length]
                if all(own[d:] != own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The row of one document, by the contract."""
    words = [w.encode() for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def rows(frame):
    return [tuple(r)[:8] for r in frame.collect()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=40), st.builds(lambda p, n: (p * 40)[:n], st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(0, 60))), min_size=1, max_size=4))
def test_equal_to_trying_every_period(documents):
    found = periodic_runs.runs_of([np.array(d, np.int64) for d in documents])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [brute(d) for d in documents]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60))
def test_all_runs_of_two_periods(words):
    """The general interface: runs of exponent two and more, of any length."""
    found = periodic_runs.runs_of([np.array(words, np.int64)], 2, 2)[0]
    assert [tuple(r) for r in found.tolist()] == brute(words, 2, 2)


def test_odd_rows(spark):
    long_text = " ".join(f"w{i % 30000}" for i in range(200_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "a b a b a b a b c"), (4, "a b a b a b a b c"), (5, "one two three"), (6, long_text), (7, "x " * 5), (8, "é é é é é é é")]
    found = periodic_runs.find_runs(spark.createDataFrame([(i, t, 1, "p") for i, t in texts], DOCS)).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found if r.doc_id != 6), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 6, [(0, 6, 1)], "a"), (4, 9, [(0, 8, 2)], "a b c"), (4, 9, [(0, 8, 2)], "a b c"), (5, 3, [], "one two three"), (7, 5, [], "x x x x x"), (8, 7, [(0, 7, 1)], "é")]
    assert got == sorted(want, key=str)
    long_row = next(r for r in found if r.doc_id == 6)
    assert [tuple(x) for x in long_row.runs] == [(0, 200_000, 30_000)] and long_row.collapsed == " ".join(f"w{i}" for i in range(30_000))
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_overlapping_and_nested_runs(spark):
    """Runs of two periods that overlap by less than both, and a run inside another's period; ties go to the smallest start."""
    text = "a a a a a a b " * 4 + "c d c d c d c d"
    frame = periodic_runs.digests(periodic_runs.find_runs(spark.createDataFrame([(9, text, 0, "")], DOCS)))
    assert brute(text.split())[0:2] == [(0, 6, 1), (0, 28, 7)]
    assert (frame.first().n_runs, frame.first().start, frame.first().length, frame.first().period, frame.first().exponent_milli) == (len(brute(text.split())), 0, 6, 1, 6000)


def test_documents_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 50)
    texts = {i: " ".join(str(x) for x in np.random.default_rng(i).integers(0, 2, 40 * i)) for i in range(1, 6)}
    found = periodic_runs.find_runs(spark.createDataFrame([(i, t, 0, "") for i, t in texts.items()], DOCS)).collect()
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in found} == {i: brute(t.split()) for i, t in texts.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = rows(queries.op11_periodic_runs(spark, DATA))
    assert sorted(found) == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in found) > 5
