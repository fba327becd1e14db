import json
import random

import pytest
from pyspark.sql import functions as F

from terrastack.operators import grid, outlines
from terrastack.sources import outlines as source

GRID = grid.GridSpec(x0=0.0, y0=40.0, dx=1.0, dy=1.0, width=60, height=40)
VERTICES = "zone string, ring long, seq int, x double, y double"


def vertices(spark, rings):
    """rings: (zone, list of points)"""
    return spark.createDataFrame([(z, n, i, float(x), float(y)) for n, (z, points) in enumerate(rings) for i, (x, y) in enumerate(points)], VERTICES)


def by_rays(rings):
    """(zone, row, col) of each cell centre with an odd number of edges to its left, edges taken lower end first."""
    found = set()
    for zone in {z for z, _ in rings}:
        edges = [sorted((a, b), key=lambda p: p[1]) for z, points in rings if z == zone for a, b in zip(points, points[1:] + points[:1], strict=True)]
        for row in range(GRID.height):
            for col in range(GRID.width):
                px, py = col + 0.5, 40 - (row + 0.5)
                if sum(1 for (x1, y1), (x2, y2) in edges if y1 <= py < y2 and x1 + (py - y1) * (x2 - x1) / (y2 - y1) <= px) % 2:
                    found.add((zone, row, col))
    return found


def cells(frame):
    return sorted((r.zone, r.grid_row, r.grid_col) for r in frame.collect())


SHAPES = {
    "hole": [("a", [(2, 2), (30, 2), (30, 30), (2, 30)]), ("a", [(10, 10), (20, 10), (20, 20), (10, 20)])],
    "vertices on centres": [("a", [(2.5, 2.5), (10.5, 2.5), (10.5, 10.5), (2.5, 10.5)]), ("b", [(10.5, 2.5), (18.5, 2.5), (18.5, 10.5), (10.5, 10.5)])],
    "star": [("a", [(30, 38), (36, 20), (55, 20), (40, 12), (46, 1), (30, 8), (14, 1), (20, 12), (5, 20), (24, 20)])],
    "beyond the grid": [("a", [(-50, -50), (200, -50), (200, 20.2), (-50, 33.3)])],
    "outside": [("a", [(70, 1), (90, 1), (80, 30)])],
    "sliver": [("a", [(1, 1), (59, 1.2), (59, 1.3)])],
    "crossing itself": [("a", [(5, 5), (40, 35), (40, 5), (5, 35)])],
}


@pytest.mark.parametrize("name", SHAPES)
def test_cover_equals_ray_crossings(spark, name):
    intervals = outlines.cover(vertices(spark, SHAPES[name]), GRID)
    assert cells(outlines.covered_cells(intervals)) == sorted(by_rays(SHAPES[name]))


def test_random_polygons_that_share_edges(spark):
    """Triangles of a jittered lattice: every cell centre inside lies in exactly one."""
    rng = random.Random(1)
    at = {(i, j): (i * 12 + (rng.uniform(-4, 4) if 0 < i < 5 else 0), j * 8 + (rng.uniform(-3, 3) if 0 < j < 5 else 0)) for i in range(6) for j in range(6)}
    rings = []
    for i in range(5):
        for j in range(5):
            rings += [(f"{i}{j}u", [at[i, j], at[i + 1, j], at[i + 1, j + 1]]), (f"{i}{j}l", [at[i, j], at[i + 1, j + 1], at[i, j + 1]])]
    found = cells(outlines.covered_cells(outlines.cover(vertices(spark, rings), GRID)))
    assert found == sorted(by_rays(rings))
    assert len(found) == len({c[1:] for c in found}) == GRID.width * GRID.height


def test_pixels_find_their_zones(spark):
    rings = SHAPES["hole"] + [("b", [(12, 12), (50, 5), (50, 35)])]
    intervals = outlines.cover(vertices(spark, rings), GRID)
    pixels = grid.cells(spark, GRID).withColumn("value", F.col("grid_row") * 100 + F.col("grid_col"))
    for block in (1, 7, 512):
        found = outlines.members(pixels, intervals, block)
        assert found.columns == ["grid_row", "grid_col", "value", "zone"]
        assert cells(found) == sorted(by_rays(rings))
    plan = outlines.members(pixels, intervals)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_outlines_of_odd_rows(spark):
    rows = [("a", 0, 0, 1.0, 1.0), ("a", 0, 1, None, 5.0), ("a", 0, 2, 9.0, 1.0), ("a", 0, 3, 9.0, 9.0), ("p", 1, 0, 5.0, 5.0), ("l", 2, 0, 1.0, 1.0), ("l", 2, 1, 30.0, 30.0), (None, 3, 0, 1.0, 1.0)]
    found = {r.zone for r in outlines.cover(spark.createDataFrame(rows, VERTICES), GRID).collect()}
    assert found == {"a"}  # points and lines hold no cell
    assert outlines.cover(spark.createDataFrame([], VERTICES), GRID).collect() == []
    with pytest.raises(ValueError, match="seq"):
        source.edges(spark.createDataFrame(rows, VERTICES).drop("seq"))


def test_geojson_lines(spark, tmp_path):
    square = [[2, 2], [30, 2], [30, 30], [2, 30], [2, 2]]
    hole = [[10, 10], [10, 20], [20, 20], [20, 10], [10, 10]]
    other = [[40, 5], [50, 5], [45, 30], [40, 5]]
    features = [
        {"type": "Feature", "properties": {"STUSPS": "AA", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"STUSPS": "BB"}, "geometry": {"type": "MultiPolygon", "coordinates": [[other], [[[1, 35], [9, 35], [5, 39], [1, 35]]]]}},
        {"type": "Feature", "properties": {"STUSPS": "CC"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"STUSPS": "DD"}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [square]}},
    ]
    (tmp_path / "zones.geojsonl").write_text("\n".join(json.dumps(f) for f in features + features[:1]) + "\n")
    found = source.read_geojson(spark, str(tmp_path / "zones.geojsonl"))
    assert {r.zone for r in found.select("zone").distinct().collect()} == {"AA", "BB"}
    rings = [("AA", [tuple(p) for p in square[:-1]]), ("AA", [tuple(p) for p in hole[:-1]]), ("BB", [(40, 5), (50, 5), (45, 30)]), ("BB", [(1, 35), (9, 35), (5, 39)])]
    assert cells(outlines.covered_cells(outlines.cover(found, GRID))) == sorted(by_rays(rings))
