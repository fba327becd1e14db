"""Mosaics: overlapping tiles merged cell by cell in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.functions.masks import source_valid
from terrastack.params import MosaicParams


def merge(tiles: DataFrame, params: MosaicParams = MosaicParams(), valid: Callable[[Column], Column] | None = None, key: list[str] = ("grid_row", "grid_col")) -> DataFrame:
    """key, value, tile_ordinal: of each cell's valid raw values the one of the last tile ('src') or the first ('dest'), scaled.

    `tiles` has raw and tile_ordinal; order is data, since partitions have none. Validity is tested on raw values; invalid ones are dropped before
    the merge, so a later empty tile never hides an earlier value. One value a cell and task is shuffled.
    """
    test = (valid or source_valid(params.nodata))(F.col("raw"))
    pick = F.max_by if params.prefer == "src" else F.min_by
    best = pick(F.struct("raw", "tile_ordinal"), "tile_ordinal")
    found = tiles.where(test).groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.raw").alias("raw"), F.col("b.tile_ordinal").alias("tile_ordinal"))
    scaled = F.col("raw") if params.scale in (None, 1) else F.col("raw") * F.lit(params.scale)
    return found.select(*key, scaled.alias("value"), "tile_ordinal")


def on_grid(mosaic: DataFrame, grid: DataFrame, key: list[str] = ("grid_row", "grid_col")) -> DataFrame:
    """Every cell of `grid`, with NULL where the mosaic has nothing."""
    return grid.select(*key).join(mosaic, list(key), "left")
