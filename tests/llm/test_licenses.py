import random
import re
import textwrap

import duckdb
import pandas as pd
import pytest

from terrastack.llm import licenses

NOTICE = "Released under the MIT License."
FULL = {name: texts[-1] for name, texts in licenses.LICENSES.items()}
PROSE = "The committee met on a rainy day. Nobody spoke of the matter at first; the minutes of the meeting are in the cupboard.\nLater on, tea was served without sugar."
TEXTS = [
    f"Intro words here.\n{NOTICE}\nmore text.",
    "x y z",
    None,
    "",
    "Prose goes on; licensed under CC BY-NC 4.0! And on.",
    "LICENSED   under the apache license, version 2.0",
    "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.",
    "The license office is under the bridge. This work is a work.",
    "This work is now licensed under the GNU General Public License, version 3.",
    "License",
    "Released under the MIT License with many other words that follow on the same line and on and on",
    NOTICE,
    NOTICE,
    "é Released under the MIT License É",
    f"Title\n\n{textwrap.fill(FULL['MIT'], 78)}\n{PROSE}",
    f"{PROSE}\n{textwrap.fill(FULL['BSD-3-Clause'], 60)}\n\n{FULL['ISC']}",
    "\n".join(f"# {line}" for line in textwrap.wrap(FULL["Apache-2.0"], 70)),
    f"{FULL['Zlib']}\n{FULL['Zlib']}",
    PROSE * 5,
    "Software without license, provided under conditions. " * 12,
]


def brute(texts, threshold):
    """All windows from the beginning of a stretch of a template's bigrams to the end of one, by sets."""
    found = []
    for doc_id, text in enumerate(texts):
        words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        best = {}
        for name, no, grams in licenses.templates():
            own, most = set(grams), licenses.most_words(len(grams), threshold)
            for i, gram in enumerate(pairs):
                if gram not in own or i and pairs[i - 1] in own:
                    continue
                for j in range(i, min(len(pairs), i + most - 1)):
                    if pairs[j] not in own or j + 1 < min(len(pairs), i + most - 1) and pairs[j + 1] in own:
                        continue
                    window = set(pairs[i : j + 1])
                    shared = len(window & own)
                    dice = 2 * shared / (len(window) + len(own))
                    if dice >= threshold:
                        rank = (-shared, -dice, name, no, i, j + 1)
                        best[i] = min(best.get(i, rank), rank)
        for m in best.values():
            if not any(o[4] <= m[5] and o[5] >= m[4] and o < m for o in best.values()):
                found.append((doc_id, m[4], m[5], m[2], m[3], -m[0], round(-m[1], 6)))
    return sorted(found)


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_equal_to_brute_force(spark, threshold):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, license string")
    got = sorted(tuple(r) for r in licenses.scan(docs, threshold).collect())
    assert got == brute(TEXTS, threshold)
    assert len(got) > 6


def test_oracle_equals_brute_force():
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}))
    assert sorted(con.sql(licenses.oracle_sql()).fetchall()) == brute(TEXTS, 0.8)


def edited(text, rng):
    """About one word in thirty replaced, left out or put in."""
    out = []
    for word in text.split():
        turn = rng.random()
        if turn < 0.01:
            continue
        out += ["changed"] if turn < 0.02 else [word, "extra"] if turn < 0.03 else [word]
    return " ".join(out)


def test_whole_licenses_are_found_however_they_are_laid_out(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for name, text in FULL.items():
        for form in (text, textwrap.fill(text, 72), textwrap.fill(text, 40, initial_indent=" * ", subsequent_indent=" * "), f"{PROSE}\n\n{textwrap.fill(text.upper(), 80)}\n\n{PROSE}", edited(text, rng) if len(text) > 300 else text):
            want[len(rows)] = name
            rows.append((len(rows), f"Copyright (c) 2020 Somebody\n\n{form}\n"))
    clean = [PROSE, PROSE * 40, "the of and under " * 400, "permission to use the software was refused. " * 30]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == {i: {name} for i, name in want.items()}


def test_notices_after_and_inside_prose(spark):
    """Notices that no line end or full stop sets apart, wrapped ones, and two in one sentence."""
    rows = [
        (1, "Copyright 2020 Somebody, a small but useful project and friends Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        (2, "this file (released under the MIT License, as all of them) holds the tables that were made in the spring", "MIT"),
        (3, "See the notes; this work is licensed\n   under the GNU General\n   Public License, version 3 and nothing else of it may be said", "GPL-3.0"),
        (4, f"{' '.join(PROSE.split())} {' '.join(FULL['MIT'].split())} {' '.join(PROSE.split())}", "MIT"),
        (5, PROSE, None),
    ]
    found = {}
    for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert {i: {r.license for r in f} for i, f in found.items()} == {i: {name} for i, _, name in rows if name}
    words = re.sub(r"[\W_]+", " ", rows[0][1].lower()).split()
    assert words[found[1][0].first_word : found[1][0].last_word + 1] == "licensed under the apache license version 2 0".split()


def test_keywords_are_in_every_match():
    known = licenses.templates()
    words = licenses.keywords(known, 0.8)
    for _, _, grams in known:
        left = [g for g in grams if not any(w in g for w in words)]
        assert len(left) < licenses.least_shared(len(grams), 0.8)


def test_long_texts_nulls_and_repeated_rows(spark):
    """A license at the end of a very long text is found; rows without id, and repeated rows, give their own results."""
    long = PROSE * 8000 + "\n" + textwrap.fill(FULL["MIT"], 70) + "\nof the software and the license\n" * 300
    rows = [(1, long, 5), (None, NOTICE, None), (None, NOTICE, None), (2, None, 1), (3, " ", 1)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, first_word int")).collect()
    assert sorted((r.doc_id or 0, r.license) for r in found) == [(0, "MIT"), (0, "MIT"), (1, "MIT")]
    assert max(r.first_word for r in found) > 200_000


def test_no_python_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = licenses.scan(docs)
    assert found.collect() == []
    assert "Arrow" not in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        licenses.scan(docs, 0)
