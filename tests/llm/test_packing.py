import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrastack.llm import packing

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def codec():
    with open(JSON, "rb") as file:
        return packing.load_codec(file.read(), PATTERN)


def test_ids_equal_the_tokenizers_library(library, codec):
    rng = random.Random(2)
    letters = "aé ß\n\t'stThe0123.,!<|endoftext|>☃𝒳\x00  "
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "don't  stop\n\n x "] + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(500)]
    for text in texts:
        assert codec.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " \t" * 700_000 + "y", "word " * 300_000], ids=["spaces", "lines", "letter", "mixed", "words"])
def test_very_long_runs_equal_the_library(library, codec, text):
    assert codec.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_two_levels_of_numbers(spark, monkeypatch):
    """Blocks of several groups: numbers are gapless, bucket after bucket, and the same each time; rows equal in id and place are told apart by their content."""
    monkeypatch.setattr(packing, "GROUPED", 3)
    rows = [(d, s, n, d * 7 + s, 99) for d in range(200) for s, n in ((0, 2048), (2048, 64), (2112, 2))] + [(5, 0, 2048, 1, 7), (5, 0, 2048, 2, 7), (None, 0, 64, 3, 9)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    found = [sorted(tuple(r) for r in packing.number_sequences(p, 20).select("sequence_id", "length", "doc_id", "ids_crc32").collect()) for p in (pieces, pieces.repartition(7).orderBy("ids_crc32"))]
    assert found[0] == found[1]
    assert [r[0] for r in found[0]] == list(range(len(rows)))
    assert [r[1] for r in found[0]] == sorted((r[2] for r in rows), reverse=True)


@pytest.mark.parametrize("tokens", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_piece_lengths(tokens):
    lengths = packing.piece_lengths(tokens)
    assert sum(lengths) == tokens
    assert all(n & (n - 1) == 0 and n <= 2048 for n in lengths)
    assert len([n for n in lengths if n < 2048]) == len({n for n in lengths if n < 2048})


def test_pieces_hold_every_id_once(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 10)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "été", "x"], k=rng.randint(0, 900))) for _ in range(20)] + [None, "", "a " * 9000, "same", "same"]
    ids = [*range(len(texts) - 2), 90, 90]
    docs = spark.createDataFrame(list(zip(ids, texts, ["z"] * len(ids), strict=True)), "doc_id long, text string, length string")
    rows = packing.pack(docs, JSON, PATTERN).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert {r.offset for r in rows} == {0}
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted((r.length for r in rows), reverse=True)
    for doc_id, text in zip(ids, texts, strict=True):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc_id})
        assert [o[0] for o in own] == [sum(o[1] for o in own[:i]) for i in range(len(own))]
        assert sum(o[1] for o in own) == len(want) == own[0][3]
        assert all(zlib.crc32(want[s : s + n].tobytes()) == c for s, n, c, _ in own)
    assert sum(r.doc_id == 90 for r in rows) == 2 * len({r.start for r in rows if r.doc_id == 90})


def test_null_ids_and_a_very_long_text(spark, library):
    long = "some words and more of them, " * 60_000
    rows = packing.pack(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None), (1, long)], "doc_id long, text string"), JSON, PATTERN).collect()
    tokens = len(library.encode(long, add_special_tokens=False).ids) + 1
    own = [r for r in rows if r.doc_id == 1]
    assert sum(r.length for r in own) == tokens == own[0].doc_tokens and max(r.length for r in own) == 2048
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    short = len(library.encode("a b c", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id is None) == 2 * short + 1


def test_empty_table_and_bad_length(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, JSON, PATTERN).collect() == []
    with pytest.raises(ValueError):
        packing.decompose(docs, JSON, PATTERN, 1000)
