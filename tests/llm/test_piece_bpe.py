import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from terrastack.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceCodec(MODEL)


@pytest.mark.parametrize("alphabet", [" ▁\n\tabcdetheréç☃𝒳#0/.'<>s\x00ﬁ⁇", "tion erathn ", "▁ ", "日本語テキスト 中文𠮷", "<0x41></s><s>"])
def test_encoding_and_decoding_equal_the_library(codec, library, alphabet):
    rng = random.Random(alphabet)
    for _ in range(800):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.decode([*ids, codec.end]) == library.decode([*ids, codec.end]), text


def test_decoding_any_ids_equals_the_library(codec, library):
    rng = random.Random(6)
    for _ in range(800):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_prefix_tokens_are_unique(codec):
    """Of the pieces that end a prefix exactly one is compatible with what comes before it."""
    for part in ("▁internationalisation", "▁theatre.", "▁aaaaaaaa"):
        last = {0: None}
        for end in range(1, len(part) + 1):
            fits = [codec.id_of[part[s:end]] for s in range(end) if part[s:end] in codec.id_of and s in last and (s == 0 or codec.fits(last[s], codec.id_of[part[s:end]]))]
            assert len(fits) == 1
            last[end] = fits[0]


def test_rows_equal_the_library(spark, library):
    rng = random.Random(2)
    texts = [None, "", " ", "same text", "same text", "x" * 100_000, "word " * 20_000] + [" ".join("".join(rng.choices("abcdehirstnoé", k=rng.randint(1, 9))) for _ in range(rng.randrange(300))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in piece_bpe.encode_and_decode(docs, MODEL).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or ""), library.eos_id()]
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == library.decode(ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert piece_bpe.encode_and_decode(docs.where("false"), MODEL).collect() == []


def test_null_ids(spark, library):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    found = piece_bpe.encode_and_decode(docs, MODEL).collect()
    assert sorted(r.n_tokens for r in found) == [1] + [len(library.encode("one two")) + 1] * 2 and {r.doc_id for r in found} == {None}
