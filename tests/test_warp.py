import math
import random

import pytest
from pyspark.sql import functions as F

from terrastack.functions import projection
from terrastack.operators import grid, warp
from terrastack.params import MosaicParams

FINE = grid.GridSpec(x0=0.0, y0=80.0, dx=1.0, dy=1.0, width=100, height=80)
CELLS = "grid_row int, grid_col int, value double"


def raster(spark, spec, keep=0.8, seed=0):
    rng = random.Random(seed)
    held = {(r, c): float(rng.randint(0, 99)) for r in range(spec.height) for c in range(spec.width) if rng.random() < keep}
    return held, spark.createDataFrame([(r, c, v) for (r, c), v in held.items()], CELLS)


def found(frame):
    return {(r.grid_row, r.grid_col): r.value for r in frame.collect()}


def near(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def plain(held, spec, target, method):
    """The same grids' coordinates, cell by cell."""
    want = {}
    for r in range(target.height):
        for c in range(target.width):
            v0, v1 = (spec.y0 - target.y0 + r * target.dy) / spec.dy, (spec.y0 - target.y0 + (r + 1) * target.dy) / spec.dy
            u0, u1 = (target.x0 - spec.x0 + c * target.dx) / spec.dx, (target.x0 - spec.x0 + (c + 1) * target.dx) / spec.dx
            v, u = (v0 + v1) / 2, (u0 + u1) / 2
            if method == "average":
                cells = [((i, j), (min(v1, i + 1) - max(v0, i)) * (min(u1, j + 1) - max(u0, j))) for i in range(math.floor(v0), math.ceil(v1)) for j in range(math.floor(u0), math.ceil(u1))]
            elif not (0 <= v < spec.height and 0 <= u < spec.width):
                continue
            elif method == "nearest":
                cells = [((math.floor(v), math.floor(u)), 1.0)]
            else:
                i, j = math.floor(v - 0.5), math.floor(u - 0.5)
                cells = [((i + a, j + b), (1 - abs(v - 0.5 - i - a)) * (1 - abs(u - 0.5 - j - b))) for a in (0, 1) for b in (0, 1)]
            cells = [(k, w) for k, w in cells if w > 1e-9 and k in held]
            if cells:
                want[r, c] = sum(held[k] * w for k, w in cells) / sum(w for _, w in cells)
    return want


@pytest.mark.parametrize("method", ["nearest", "bilinear", "average"])
@pytest.mark.parametrize("block", [7, 256])
def test_equal_to_cell_by_cell(spark, method, block):
    held, source = raster(spark, FINE)
    for target in (grid.GridSpec(-3.25, 85.0, 3.5, 2.75, 40, 35), grid.GridSpec(20.3, 60.1, 0.4, 0.7, 30, 20), FINE):
        near(found(warp.warp(source, FINE, target, method, block=block)), plain(held, FINE, target, method))


def test_masked_cells_take_no_part(spark):
    rows = [(0, 0, 10.0), (0, 1, None), (1, 0, 20.0), (1, 1, 30.0)]
    spec, whole = grid.GridSpec(0, 2, 1, 1, 2, 2), grid.GridSpec(0, 2, 2, 2, 1, 1)
    source = spark.createDataFrame(rows, CELLS)
    assert found(warp.warp(source, spec, whole, "average")) == {(0, 0): 20.0}
    assert found(warp.warp(source, spec, whole, "bilinear")) == {(0, 0): 20.0}
    assert warp.warp(source.where("false"), spec, whole, "average").collect() == []
    assert warp.warp(source.where("value IS NULL"), spec, whole, "nearest").collect() == []


@pytest.mark.parametrize("method", ["nearest", "bilinear", "average"])
def test_other_coordinates_in_blocks_of_any_size(spark, method):
    """Albers onto degrees over a thousand kilometres: no block's cells are lost, and values are those of the place."""
    albers = grid.GridSpec(-600000.0, 2300000.0, 20000.0, 20000.0, 60, 60)
    degrees = grid.GridSpec(-104.0, 44.0, 0.31, 0.17, 60, 55, crs="EPSG:4326")
    rows = grid.cells(spark, albers)
    x, y = albers.centre(F.col("grid_row"), F.col("grid_col"))
    source = rows.withColumn("value", x / 1000 + y / 500)
    whole = found(warp.warp(source, albers, degrees, method, block=1000))
    for block in (5, 16):
        near(found(warp.warp(source, albers, degrees, method, block=block)), whole)
    lon, lat = degrees.centre(F.col("grid_row"), F.col("grid_col"))
    px, py = projection.to_albers(lon, lat)
    placed = {(r.grid_row, r.grid_col): (r.x, r.y) for r in grid.cells(spark, degrees).select("grid_row", "grid_col", px.alias("x"), py.alias("y")).collect()}
    assert len(whole) > 1000
    for key, value in whole.items():
        x, y = placed[key]
        inner = -580000 < x < 580000 and 1120000 < y < 2280000
        if inner:
            assert abs(value - (x / 1000 + y / 500)) < (31 if method != "bilinear" else 1e-6)


def test_blocks_without_source_cells_are_left_out(spark):
    _, source = raster(spark, FINE)
    target = grid.GridSpec(0.0, 80.0, 1.0, 1.0, 1000, 800)
    blocks = warp.target_blocks(source.where("grid_row < 10 AND grid_col < 10"), FINE, target, 16).collect()
    assert 1 <= len(blocks) <= 9


def test_layers_stay_apart_and_refusals(spark):
    _, source = raster(spark, FINE)
    both = source.withColumn("band", F.lit(1)).unionByName(source.withColumns({"band": F.lit(2), "value": F.col("value") + 1000}))
    target = grid.GridSpec(0.5, 79.5, 2.0, 2.0, 40, 30)
    rows = warp.warp(both, FINE, target, "average", keys=["band"]).collect()
    first = {(r.grid_row, r.grid_col): r.value for r in rows if r.band == 1}
    near({(r.grid_row, r.grid_col): r.value - 1000 for r in rows if r.band == 2}, first)
    with pytest.raises(ValueError, match="cubic"):
        warp.warp(source, FINE, target, "cubic")
    with pytest.raises(ValueError, match="EPSG:32633"):
        warp.warp(source, FINE, grid.GridSpec(0, 1, 1, 1, 1, 1, crs="EPSG:32633"))


def test_no_data_never_mixes_into_means(spark):
    tiles = spark.createDataFrame([(0, 0, -9999.0, 0), (0, 1, 8.0, 0), (0, 0, 100.0, 1), (0, 1, -9999.0, 1)], "grid_row int, grid_col int, raw double, tile_ordinal int")
    spec, whole = grid.GridSpec(0, 1, 1, 1, 2, 1), grid.GridSpec(0, 1, 2, 1, 1, 1)
    for prefer, value, tile in (("src", 1.0, 1), ("dest", 0.08, 0)):
        r = warp.warp_mosaic(tiles, spec, whole, MosaicParams(prefer=prefer, resampling="average")).first()
        assert (round(r.value, 9), r.tile_ordinal) == (value, tile)


def test_tiles_of_several_grids_and_systems(spark):
    """An Albers tile above and a finer one in degrees below another: the order of ordinals decides, not that of the tables."""
    target = grid.GridSpec(-200000.0, 2000000.0, 10000.0, 10000.0, 30, 30)
    near_, far = grid.GridSpec(-100000.0, 1900000.0, 5000.0, 5000.0, 40, 40), grid.GridSpec(-99.0, 41.0, 0.05, 0.05, 80, 80, crs="EPSG:4269")
    cells = lambda spec, value, ordinal: grid.cells(spark, spec).withColumns({"raw": F.lit(value), "tile_ordinal": F.lit(ordinal)})
    for order in ((1, 0), (0, 1)):
        layers = [(cells(near_, 100.0, order[0]), near_), (cells(far, 200.0, order[1]), far)]
        rows = {(r.grid_row, r.grid_col): (round(r.value, 9), r.tile_ordinal) for r in warp.warp_layers(layers, target).collect()}
        alone = found(warp.warp(layers[0][0].withColumn("value", F.col("raw")), near_, target))
        assert alone and {rows[k] for k in alone} <= ({(1.0, 1)} if order == (1, 0) else {(2.0, 1), (1.0, 0)})
        assert {v for k, v in rows.items() if k not in alone} == {(2.0, order[1])}
    with pytest.raises(ValueError, match="no tiles"):
        warp.warp_layers([], target)
