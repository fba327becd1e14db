import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import Row

from terrastack.llm import blocks, chunk_dedup

SCHEMA = "doc_id long, text string, lang string, n_chars long, block_ string, c0 string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(n))


def brute_digest_groups(texts):
    """Chunks by the rule itself: the hash of the last 16 bytes at each word end, in plain integers."""
    gear = [int(g) for g in chunk_dedup.GEAR]
    out = []
    for text in texts:
        raw, start, chunks = text.encode(), 0, []
        for end in range(1, len(raw) + 1):
            cut = end == len(raw)
            if not cut and raw[end : end + 1].isspace() and not raw[end - 1 : end].isspace():
                window = raw[max(0, end - 16) : end]
                value = sum(gear[b] << (len(window) - 1 - i) for i, b in enumerate(window)) % 2**64
                cut = (value >> 1 & 0xFFFF) < 0x10000 // chunk_dedup.CUT_WORDS
            if cut:
                chunks.append(b" ".join(raw[start:end].split()))
                start = end
        out.append(chunks)
    return out


def test_chunks_and_digests_equal_brute_force():
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 80)).replace(" ", rng.choice([" ", "\n", " \t "])) for _ in range(60)] + [" lead", "tail ", "é ß ☃ a b", "a", "  "]
    texts += [texts[0], "x  " + texts[1]]
    chunks = chunk_dedup.Chunks(texts)
    want = brute_digest_groups(texts)
    seen = {}
    for i, parts in enumerate(want):
        own = np.flatnonzero(chunks.row == i)
        assert len(own) == len(parts)
        for j, part in zip(own, parts, strict=True):
            assert chunks.words[j] == len(part.split())
            assert seen.setdefault(int(chunks.digest[j]), part) == part
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("block", [3000, 10**7])
def test_planted_passages_are_found_and_clean_documents_left(spark, block):
    rng = random.Random(7)
    passages = [words(rng, 55) for _ in range(12)]
    line = words(rng, 9)
    texts = [f"{line}\n{words(rng, 120)}" for _ in range(60)]
    planted = {}
    for k, p in enumerate(passages):
        for d in (3 * k + 1, 3 * k + 2, 40 + k):
            texts[d] += " " + p + "\n" + words(rng, 30)
            planted.setdefault(k, []).append(d)
    rows = [(i, t, "x", len(t), "b", "c") for i, t in enumerate(texts)] + [(100, None, None, None, None, None), (101, "", "x", 0, "b", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = chunk_dedup.repeated_passages(docs, block_bytes=block).collect()
    expected = {(d, ds[0]) for ds in planted.values() for d in ds[1:]}
    assert {(r.doc_id, r.kept_doc_id) for r in found} == expected
    clean = {r.doc_id: r for r in chunk_dedup.without_repeats(docs, block_bytes=block).collect()}
    assert len(clean) == len(rows)
    touched = {d for d, _ in expected}
    for i, text in enumerate(texts):
        row = clean[i]
        assert (row.text == text) == (i not in touched)
        assert row.n_chars == len(row.text) and (row.block_, row.c0) == ("b", "c")
    for k, ds in planted.items():
        assert passages[k] in clean[ds[0]].text
        assert all(passages[k] not in clean[d].text for d in ds[1:])
    assert clean[100].text is None and clean[101].text == ""


def test_insertion_does_not_shift_chunks():
    rng = random.Random(3)
    text = words(rng, 400)
    before = chunk_dedup.Chunks([text]).digest
    after = chunk_dedup.Chunks([text[:500] + "inserted " + text[500:]]).digest
    assert len(np.intersect1d(before, after)) >= len(np.unique(before)) - 4


def test_repeats_inside_a_document_and_copies(spark):
    rng = random.Random(9)
    p, q = words(rng, 60), words(rng, 80)
    docs = spark.createDataFrame([(5, f"{p} middle {p}"), (6, q), (7, q), (7, q), (None, q)], "doc_id long, text string")
    found = chunk_dedup.repeated_passages(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.kept_doc_id) for r in found) == [(-1, 6), (5, 5), (7, 6), (7, 6)]
    assert found[0].asDict().keys() == Row(doc_id=1, kept_doc_id=1, start_byte=1, n_bytes=1, n_words=1, passage="").asDict().keys()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert chunk_dedup.repeated_passages(docs).collect() == []
    assert chunk_dedup.without_repeats(docs).collect() == []


def brute_spans(rows, min_words=16, min_owner=12):
    """(doc_id, owner, first byte, last byte) of the passages, by plain dictionaries: chunks by the rule itself, words compared as words."""
    texts = [t or "" for _, t in rows]
    chunks = []
    for (doc, _), parts in zip(rows, brute_digest_groups(texts), strict=True):
        own, at, raw = [], 0, texts[len(chunks)].encode()
        for part in parts:  # the chunk's place: up to the end of its last word, white space after it goes to the next one
            end = at
            for word in part.split():
                end = raw.index(word, end) + len(word)
            own.append((part, at, end if part else len(raw)))
            at = end
        chunks.append((doc, own))
    first, count = {}, {}
    for doc, own in sorted(chunks, key=lambda c: c[0]):
        for part, start, _ in own:
            first.setdefault(part, (doc, start))
            count[part] = count.get(part, 0) + 1

    def words_of(doc):
        raw = dict(rows)[doc].encode()
        return raw, [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]

    def grow(doc, edge, owner_doc, owner_edge, side):
        (raw, own), (other, theirs) = words_of(doc), words_of(owner_doc)
        a = [s for s in own if (s[1] <= edge if side < 0 else s[0] >= edge)][::side]
        b = [s for s in theirs if (s[1] <= owner_edge if side < 0 else s[0] >= owner_edge)][::side]
        many = 0
        while many < min(len(a), len(b), chunk_dedup.REACH) and raw[slice(*a[many])] == other[slice(*b[many])]:
            many += 1
        if not many:
            return edge, 0
        return (a[many - 1][1] if side > 0 else (a[many][1] if many < len(a) else 0)), many

    found = []
    for doc, own in chunks:
        run = []
        for item in [*own, None]:
            if item and item[0] and count[item[0]] > 1 and first[item[0]] != (doc, item[1]):
                run.append(item)
                continue
            size = lambda some: sum(len(c[0].split()) for c in some)
            if size(run) >= chunk_dedup.CANDIDATE_WORDS:
                weight = {}
                for c in run:
                    weight[first[c[0]][0]] = weight.get(first[c[0]][0], 0) + len(c[0].split())
                best = max(weight.values())
                main = min(o for o, w in weight.items() if w == best)
                along = set()
                for i, (c, d) in enumerate(zip(run, run[1:], strict=False)):
                    (o, p), (q, r) = first[c[0]], first[d[0]]
                    if o == q and abs((r - p) - (d[1] - c[1])) <= 2 * len(c[0].split()) + 4:
                        along |= {i, i + 1}
                if run:
                    left, right = [c for c in run if first[c[0]][0] == main][0], [c for c in run if first[c[0]][0] == main][-1]
                    p = first[left[0]][1]
                    lower, before = grow(doc, left[1], main, p, -1)
                    owner_end = next(e for part, s, e in dict(chunks)[main] if s == first[right[0]][1])
                    upper, after = grow(doc, right[2], main, owner_end, 1)
                    start, end = min(run[0][1], lower), max(run[-1][2], upper)
                    enough = len(dict(rows)[doc].encode()[start:end].split()) >= min_words and max(best, size([run[i] for i in along])) + before + after >= min_owner
                    if not enough:
                        run = []
                        continue
                    if found and found[-1][0] == doc:
                        start = max(start, found[-1][3])
                    found.append((doc, main, start, end))
            run = []
    return sorted(found)


@pytest.mark.parametrize(("block", "fan"), [(2000, 1024), (2000, 3), (10**7, 1024)])
def test_rows_equal_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    rng = random.Random(21)
    stock = [words(rng, rng.randint(2, 30)) for _ in range(25)]
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randint(3, 40)) if rng.random() < 0.6 else rng.choice(stock) for _ in range(rng.randint(1, 8))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(80, rows[3][1]), (81, rows[5][1] + " " + rows[5][1]), (82, ""), (83, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.kept_doc_id, r.start_byte, r.start_byte + r.n_bytes) for r in chunk_dedup.repeated_passages(docs, block_bytes=block).collect())
    want = brute_spans(rows)
    assert got == want and len(want) > 20
    clean = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs, block_bytes=block).collect()}
    for doc, text in rows:
        raw = text.encode()
        gone = {b for d, _, s, e in want if d == doc for b in range(s, e)}
        assert clean[doc].encode() == bytes(x for b, x in enumerate(raw) if b not in gone)


def test_a_passage_of_several_owners_goes(spark):
    """Each part of a passage is in an earlier document of its own, and none of these has 12 words of it alone."""
    rng = random.Random(33)
    passage = words(rng, 80).split()
    rows = [(i, f"{words(rng, 50)} {' '.join(passage[5 * i : 5 * i + 12])} {words(rng, 50)}") for i in range(15)]
    rows += [(50, f"{words(rng, 60)} {' '.join(passage)} {words(rng, 60)}")]
    found = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {50} and sum(r.n_words for r in found) > 30


@pytest.mark.parametrize(("length", "least"), [(20, 0.9), (30, 0.97), (50, 1.0)])
def test_recall_of_planted_passages(spark, length, least):
    """Passages from 20 words on, in two documents each, are found, ends and all; stock lines of 12 words stay."""
    rng = random.Random(length)
    vocabulary = [words(rng, 1) for _ in range(5000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, planted = [], {}
    for i in range(0, 400, 2):
        passage = text(length)
        rows += [(j, f"{text(rng.randint(20, 60))} {passage} {text(30)}") for j in (i, i + 1)]
        planted[i + 1] = (rows[-1][1].index(passage), len(passage))
    line = text(12)
    rows += [(1000 + i, f"{text(40)} {line} {text(40)}") for i in range(50)]
    found = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} <= planted.keys()
    assert len({r.doc_id for r in found}) >= least * len(planted)
    inside = sum(max(0, min(r.start_byte + r.n_bytes, at + n) - max(r.start_byte, at)) for r in found for at, n in [planted[r.doc_id]])
    assert inside >= (least - 0.02) * sum(n for _, n in planted.values())
    assert sum(r.n_bytes for r in found) - inside <= 0.03 * inside  # white space before a passage, and words that are the same by chance


def test_text_without_white_space_is_cut_between_characters(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = text(300)
    rows = [(i, text(400) + (shared if i in (2, 5) else "") + text(400)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunk_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(5, 2)}
    assert all(r.passage in shared for r in found) and sum(len(r.passage) for r in found) > 220
    clean = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs).collect()}
    assert all((clean[i] == t) == (i != 5) for i, t in rows)


def test_very_long_texts_and_many_passages(spark):
    """Texts of a megabyte with hundreds of passages: time is in proportion to their length."""
    rng = random.Random(4)
    passages = [words(rng, 40) for _ in range(600)]
    rows = [(1, " ".join(f"{p} {words(rng, 20)}" for p in passages)), (2, " ".join(f"{words(rng, 20)} {p}" for p in passages)), (3, "a" * 1_000_000), (4, " " * 1_000_000)]
    found = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in found} == {(2, 1)} and len(found) > 590
    clean = {r.doc_id: r.text for r in chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(clean[2].split()) < 20 * 600 + 0.06 * 40 * 600 and clean[3] == rows[2][1] and clean[4] == rows[3][1]


def test_one_repeated_row_is_no_hot_block(spark):
    """Half of all rows are one row without an id: blocks stay even, all rows stay, and the catalog keeps no entry."""
    rng = random.Random(12)
    rows = [(None, words(rng, 30))] * 1500 + [(i, words(rng, 30)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    dealt, many = blocks.deal(docs, 10_000)
    sizes = {}
    for r in dealt.collect():
        sizes[r.block_] = sizes.get(r.block_, 0) + blocks.pa.ipc.open_stream(r.rows_).read_all().num_rows
    assert sum(sizes.values()) == 3000 and many > 20 and max(sizes.values()) < 3 * 3000 / many
    assert {t.name for t in spark.catalog.listTables()} == before
    clean = chunk_dedup.without_repeats(docs, block_bytes=10_000).collect()
    assert sorted((r.doc_id is None, r.text) for r in clean) == sorted((i is None, t) for i, t in rows)


def test_passages_are_kept_from_the_step_that_finds_them_and_grow_without_chunks(monkeypatch):
    """Texts were cut into chunks a third time before; now rows come in any order, and the last step needs the texts and what the block kept alone."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    shared = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(80)), shared, *(word() for _ in range(80))]) for _ in range(3)]
    rows = pa.table({"doc_id": pa.array([4, 4, 9, None, None], pa.int64()), "text": [texts[1], texts[0], texts[2], None, ""]})
    wanted, ids = chunk_dedup._ordered(rows)
    chunks = chunk_dedup.Chunks(wanted.column("text").to_pylist())
    keys, arrays = chunk_dedup._known(rows)
    owned, _ = chunk_dedup._owners(keys, np.arange(len(keys)), arrays)
    every, told, kept = chunk_dedup.Repeats(chunks, ids, *owned, 16, 12).tells()
    memo = blocks.Memo(blocks.Lookup(1, [chunk_dedup._AROUND], [chunk_dedup._AROUND], None, None), chunk_dedup._PASSAGE)
    sent = memo.ask(7, every, told, kept)
    back = memo.along(sent.filter(pc.less(sent.column("range_"), 0)))[0]
    assert len(kept) > 0 and (back == kept).all()
    monkeypatch.setattr(chunk_dedup, "Chunks", None)
    found = []
    for order in ([0, 1, 2, 3, 4], [4, 1, 3, 2, 0]):
        again, _ = chunk_dedup._ordered(rows.take(order))
        encoded = chunk_dedup._encoded(again.column("text").to_pylist())
        found.append([(encoded[r][s:e].decode(), w, o) for r, s, e, w, o in chunk_dedup._grown(encoded, back, told[0], 16, 12)])
    assert found[0] == found[1] and len(found[0]) == 2
    assert all(shared in passage and words >= 60 and owner == 4 for passage, words, owner in found[0])
    empty = np.zeros(0, chunk_dedup._PASSAGE)
    assert len(memo.along(memo.ask(0, every[:0], [told[0][:0]], empty))[0]) == 0
    assert chunk_dedup._grown([b"", b""], empty, told[0][:0], 16, 12) == []
