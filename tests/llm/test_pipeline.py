import random

import corpus_pipeline
import numpy as np
import pytest

from terrastack.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, fp_ string, block_ string, n_chars long, score double"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """Clean documents, shouted junk, toxic ones, near copies, and a passage that documents share; some labelled."""
    rng = random.Random(12)
    rows, labels, kind = [], [], {}
    shared = prose(rng, 60)
    for i in range(300):
        text, what = prose(rng, rng.randint(40, 160)), "clean"
        if i % 5 == 1:
            text, what = " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split()), "junk"
        elif i % 5 == 2:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zzidiot", "zzmoron", "zzstupid"]))
            text, what = " ".join(words), "toxic"
        elif i % 20 == 3:
            text, what = text + " " + shared + " " + prose(rng, 20), "shared"
        elif i % 20 == 8:
            text, what = next(r[1] for r in rows if kind[r[0]] == "clean"), "copy"
        kind[i] = what
        rows.append((i, text, "en", "s", len(text)))
        if i % 4 != 3:
            labels.append((i, int(what != "junk"), int(what == "toxic")))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, kind, shared


def test_stages_do_their_work(spark, corpus):
    folder, rows, kind, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    expected = set(texts)
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], ("junk", "toxic", "copy"), strict=True):
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs.write.mode("overwrite").parquet(f"{folder}/{gone}")
        docs = spark.read.parquet(f"{folder}/{gone}")
        expected -= {i for i in expected if kind[i] == gone}
        found = {r.doc_id for r in docs.collect()}
        assert not any(kind[i] == gone for i in found) and found <= expected
        assert len(found) >= 0.97 * len(expected), name
        expected = found
    cleaned = {r.doc_id: r for r in corpus_pipeline.substring_stage(spark, docs, folder).collect()}
    assert set(cleaned) == expected
    holders = [i for i in sorted(expected) if kind[i] == "shared"]
    assert shared in cleaned[holders[0]].text
    assert all(shared not in cleaned[i].text and len(cleaned[i].text) == cleaned[i].n_chars for i in holders[1:])
    assert all(cleaned[i].text == texts[i] for i in expected if kind[i] == "clean")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == expected
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces)))


def test_classifiers_hold_out_and_score(spark, corpus):
    folder, rows, kind, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for scored, bad in ((quality.score_quality(docs, labels), "junk"), (toxicity.score_toxicity(docs, labels), "toxic")):
        found = scored.collect()
        assert len(found) == len(rows) and any(r.held_out for r in found)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
        right = [(r.predicted == 1) == ((kind[r.doc_id] == "junk") is False if bad == "junk" else kind[r.doc_id] == "toxic") for r in found if r.held_out]
        assert np.mean(right) > 0.95


def test_misspelt_words_are_toxic_too(spark, corpus):
    folder, *_ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    model = model.value
    scores = model.score(["abc zzidiott def", "abc zzstupidd def", "abc defg hij", None, ""])
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.5
    assert scores[3] == scores[4]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, corpus, stage):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names go through every stage."""
    folder, *_ = corpus
    long = prose(random.Random(1), 30_000)
    rows = [(1, None, "a", "b", None, 1.0), (2, "", None, None, 0, None), (3, "Plain words here.", "a", "b", 17, 2.0)] * 2 + [(None, "Plain words here.", "a", "b", 17, 3.0), (4, long, "x", "y", len(long), 4.0)]
    docs = spark.createDataFrame(rows, EXTRA)
    out = stage(spark, docs, folder)
    found = out.collect()
    assert {3, 4} <= {r.doc_id for r in found}  # clean documents stay, very long ones too
    if stage is not corpus_pipeline.packing_stage:
        assert out.columns == docs.columns
        assert all(tuple(r) in {tuple(x) for x in rows} or r.n_chars is None for r in found)
    assert stage(spark, spark.createDataFrame([], EXTRA), folder).collect() == []
