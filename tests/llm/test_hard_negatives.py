import os

import duckdb
import numpy as np
import pytest

from terrastack.llm import hard_negatives, queries

DATA = "/root/testdata/sf0.001"
ROWS = "vec_id long, label long, vector array<long>, rank int, own string"
TABLE = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10):
    """Compares each anchor with all rows, in Python's whole numbers."""
    found = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for n, (anchor, label, vector) in enumerate(rows):
        if anchor % every:
            continue
        scores = [(-dot(vector, v), i, m) for m, (i, _, v) in enumerate(rows)]
        same = sorted(s for s in scores if s[2] != n and rows[s[2]][1] == label)[:positives]
        other = sorted(s for s in scores if rows[s[2]][1] != label)
        for p, positive, _ in same:
            best = [s for s in other if 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            found += [(anchor, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(best, 1)]
    return sorted(found)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in rows], ROWS)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, **options).collect())


def clustered(many, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 41, (12, dims))
    vectors = centres[rng.integers(0, 12, many)] + rng.integers(-5, 6, (many, dims))
    return [(int(i), int(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("dims, cell, chunk", [(2, 40, 8), (3, 100, 16), (16, 150, 32)])
def test_equal_to_comparing_all(spark, monkeypatch, dims, cell, chunk):
    """Many pivots, cells and chunks, so that both rounds have intervals to leave out."""
    for name, value in {"PIVOT_ROWS": 2 * cell, "CELL_ROWS": cell, "PART_ROWS": 2 * cell, "CHUNK": chunk, "GROUP_ANCHORS": 20}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(1500, dims, dims)
    assert mined(spark, rows, anchor_every=50) == brute(rows, 50)


def test_copies_and_ties(spark, monkeypatch):
    """A third of the rows is one vector; many scores are equal; repeated rows, a repeated anchor among them."""
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [3, 2]) for i in range(150)] + [(i, int(rng.integers(0, 3)), rng.integers(-3, 4, 2).tolist()) for i in range(150, 420)]
    rows += [(100, 1, [3, 2]), (100, 1, [3, 2]), (100, 1, [3, 1]), (200, 2, [1, 1]), (7, 1, [3, 2]), rows[300], rows[300]]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, 1, [5, 5]), (1, 1, [4, 4]), (2, 2, [3, 3]), (3, 2, [2]), (4, 3, []), (100, 9, [1, 1]), (-100, 1, [-5, -5])]
    frame = [(*r, 1, "x") for r in rows] + [(None, 1, [9, 9], 1, "x"), (5, None, [9, 9], 1, "x"), (6, 2, None, 1, "x"), (7, 2, [1, None], 1, "x")]
    found = hard_negatives.hard_negatives(spark.createDataFrame(frame, ROWS))
    padded = [(i, lab, (v + [0, 0])[:2]) for i, lab, v in rows]
    assert sorted(tuple(r) for r in found.collect()) == brute(padded)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], ROWS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1], 1, "x")], ROWS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [0], 1, "x"), (1, 1, [0], 1, "x"), (2, 2, [0], 1, "x")], ROWS)).collect() == [(0, 1, 1, 2, 0, 0)]


def test_large_components_are_exact(spark):
    """Products beyond 2^53 are whole numbers too."""
    rows = [(i, i % 2, [(1 << 28) + i, (1 << 29) - 3 * i, i]) for i in range(40)] + [(100, 0, [(1 << 28) + 1, 1 << 28, 1])]
    assert mined(spark, rows, anchor_every=20) == brute(rows, 20)


def test_bounds_leave_cells_out():
    """Half squared distances bound every score of a cell from both sides."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 51, (300, 6))
    radius = float(np.sqrt((rows**2).sum(1).max()))
    space = hard_negatives.Space(6, radius, rng.normal(0, 30, (4, 7)), True)
    far_rows, far = space.distances(rows, True), space.distances(rows[:20], False)
    scores = rows[:20] @ rows.T
    for p in range(4):
        below, above = hard_negatives._reach(space, (rows[:20] ** 2).sum(1)[:, None], far[:, [p]], far_rows[:, p], far_rows[:, p])
        assert (below <= scores).all() and (scores <= above).all()
        assert (above < np.abs(scores).max()).any()


def test_scaled_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, [0.5, -0.001], 9), (8, [1.0], 3), (1, [nan], 1), (2, [inf], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0], None), (None, [1.0], 1), (-14, [0.0], 2)]
    found = hard_negatives.scaled_rows(spark.createDataFrame(rows, TABLE)).collect()
    assert sorted(tuple(r) for r in found) == [(-14, 3, [0]), (7, 0, [128, -1]), (8, 3, [256])]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_brute_force(spark):
    rows = []
    for i, v, label in duckdb.sql(f"SELECT vec_id, embedding, label FROM '{DATA}/embeddings.parquet'").fetchall():
        rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    found = queries.op13_hard_negatives(spark, DATA)
    assert dict(found.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
