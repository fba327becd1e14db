"""The whole pipeline against plain Python: every stage's decisions, one document at a time."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_chunk_dedup import brute_spans
from test_near_copies import brute_kept
from tokenizers import Tokenizer

from terrastack.llm import packing, quality, toxicity


TOXIC = ["zzidiot", "zzmoron", "zzstupid"]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(77)
    shared = [prose(rng, 60) for _ in range(4)]
    rows, labels = [], []
    for i in range(160):
        text, junk, toxic = prose(rng, rng.randint(30, 110)), i % 7 == 1, i % 7 == 2
        if junk:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
            text = " ".join(words)
        if i % 7 == 3:
            text = f"{text} {rng.choice(shared)} {prose(rng, 15)}"
        if i % 7 == 4 and i > 20:
            words = rows[i - 14][1].split()  # a near copy: one word in forty is another
            text = " ".join(rng.choice("xyz") * 4 if rng.random() < 0.025 else w for w in words)
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, rows[0][1], "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("brute"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r[1] for r in rows}


def by_model(spark, folder, texts, fit, keep):
    """What the model of one stage, learned from the rows that are left, says of each text by itself."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).value
    return {i: t for i, t in texts.items() if keep(float(model.score([t])[0]))}


def test_run_equals_brute_force(spark, corpus):
    folder, texts = corpus
    before = len(texts)
    texts = by_model(spark, folder, texts, quality.fit_quality, lambda s: s >= 0.5)
    assert len(texts) < before
    before = len(texts)
    texts = by_model(spark, folder, texts, toxicity.fit_toxicity, lambda s: s < 0.5)
    assert len(texts) < before
    ids = sorted(texts)
    kept = [ids[i] for i in sorted(brute_kept([texts[i] for i in ids]))]
    assert len(kept) < len(ids)
    gone = brute_spans([(i, texts[i]) for i in kept])
    assert gone
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in kept:
        raw = (texts[i] or "").encode()
        drop = {b for doc, _, start, end in gone if doc == i for b in range(start, end)}
        text = bytes(x for b, x in enumerate(raw) if b not in drop).decode()
        tokens, start = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for length in packing.piece_lengths(len(tokens)):
            want.append((i, start, length, zlib.crc32(tokens[start : start + length].tobytes()), len(tokens), 0))
            start += length
    rows = corpus_pipeline.run(spark, folder).collect()
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows)
    assert got == sorted(want)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_sequence = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_sequence == sorted(by_sequence, reverse=True)
