"""Rasters brought onto another grid, of the same or another coordinate system.

The map is driven by the target: each target cell is mapped back to where it lies on the source grid. Target blocks come first: the envelope of a block, mapped, names the source blocks
that it can touch, and blocks that touch none that is there are left out before any of their cells is made. Then cells name source cells with a weight and meet
them in one join by row and column; weights of masked or absent source cells are left out and the rest count in proportion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.functions.masks import source_valid
from terrastack.functions.projection import transform
from terrastack.operators import mosaic
from terrastack.operators.grid import GridSpec
from terrastack.params import RESAMPLING, MosaicParams

#: A source cell of which a target cell covers less than this is not touched.
LEAST_WEIGHT = 1e-9


def _on_source(target: GridSpec, source: GridSpec, row: Column, col: Column) -> tuple[Column, Column]:
    """(down, across): where a point of the target grid, in rows and columns, lies on the source grid, in its rows and columns."""
    x, y = F.lit(target.x0) + col * target.dx, F.lit(target.y0) - row * target.dy
    sx, sy = transform(x, y, target.crs, source.crs)
    return (F.lit(source.y0) - sy) / source.dy, (sx - F.lit(source.x0)) / source.dx


def target_blocks(source: DataFrame, source_grid: GridSpec, target_grid: GridSpec, block: int = 256) -> DataFrame:
    """row_off, col_off, rows, cols of the target blocks whose mapped envelope meets a source block that holds cells.

    The envelope is that of nine points of the block, widened by a quarter of its size and two cells, so that curved edges stay in it.
    """
    spark = source.sparkSession
    down, across = -(-target_grid.height // block), -(-target_grid.width // block)
    ids = spark.range(down * across)
    blocks = ids.select((F.floor(F.col("id") / across) * block).alias("row_off"), (F.col("id") % across * block).alias("col_off"))
    blocks = blocks.withColumns({"rows": F.least(F.lit(block), F.lit(target_grid.height) - F.col("row_off")), "cols": F.least(F.lit(block), F.lit(target_grid.width) - F.col("col_off"))})
    nine = F.array(*[F.struct((F.col("row_off") + F.col("rows") * (i / 2)).alias("r"), (F.col("col_off") + F.col("cols") * (j / 2)).alias("c")) for i in range(3) for j in range(3)])
    points = blocks.withColumn("p", F.explode(nine))
    v, u = _on_source(target_grid, source_grid, F.col("p.r"), F.col("p.c"))
    key = ["row_off", "col_off", "rows", "cols"]
    spans = points.select(*key, v.alias("v"), u.alias("u")).groupBy(*key).agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("u").alias("u0"), F.max("u").alias("u1"))

    def numbers(low: str, high: str, most: int) -> Column:
        room = (F.col(high) - F.col(low)) * 0.25 + 2
        first, last = F.floor(F.greatest(F.col(low) - room, F.lit(0.0)) / block), F.floor(F.least(F.col(high) + room, F.lit(float(most - 1))) / block)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    touched = spans.withColumn("block_row", F.explode(numbers("v0", "v1", source_grid.height))).withColumn("block_col", F.explode(numbers("u0", "u1", source_grid.width)))
    present = source.select(F.floor(F.col("grid_row") / block).alias("block_row"), F.floor(F.col("grid_col") / block).alias("block_col")).distinct()
    return touched.join(present, ["block_row", "block_col"], "left_semi").select(*key).distinct()


def _touches(cells: DataFrame, method: str, target: GridSpec, source: GridSpec) -> DataFrame:
    """grid_row, grid_col, source_row, source_col, weight: the source cells that each target cell takes its value from."""
    row, col = F.col("grid_row"), F.col("grid_col")
    key = ["grid_row", "grid_col"]
    if method == "average":
        corners = [_on_source(target, source, row + i, col + j) for i in (0, 1) for j in (0, 1)]
        mapped = cells.select(*key, *[c.alias(f"{n}{k}") for k, pair in enumerate(corners) for n, c in zip("vu", pair, strict=True)])
        ends = {f"{n}_{k}": f(*[F.col(f"{n}{i}") for i in range(4)]) for n in "vu" for k, f in (("low", F.least), ("high", F.greatest))}
        boxes = mapped.select(*key, *[c.alias(n) for n, c in ends.items()])
        boxes = boxes.where((F.col("v_high") > 0) & (F.col("u_high") > 0) & (F.col("v_low") < source.height) & (F.col("u_low") < source.width))
        side = lambda n, most: F.explode(F.sequence(F.greatest(F.floor(f"{n}_low"), F.lit(0)), F.least(F.ceil(f"{n}_high") - 1, F.lit(most - 1))))
        share = lambda n, i: F.least(F.col(f"{n}_high"), F.col(i) + 1) - F.greatest(F.col(f"{n}_low"), F.col(i).cast("double"))
        found = boxes.withColumn("source_row", side("v", source.height)).withColumn("source_col", side("u", source.width)).withColumn("weight", share("v", "source_row") * share("u", "source_col"))
    else:
        v, u = _on_source(target, source, row + 0.5, col + 0.5)
        mapped = cells.select(*key, v.alias("v"), u.alias("u")).where((F.col("v") >= 0) & (F.col("u") >= 0) & (F.col("v") < source.height) & (F.col("u") < source.width))
        if method == "nearest":
            found = mapped.select(*key, F.floor("v").alias("source_row"), F.floor("u").alias("source_col"), F.lit(1.0).alias("weight"))
        else:
            first = mapped.withColumns({"r": F.floor(F.col("v") - 0.5), "c": F.floor(F.col("u") - 0.5)})
            first = first.withColumns({"fr": F.col("v") - 0.5 - F.col("r"), "fc": F.col("u") - 0.5 - F.col("c")})
            part = lambda name, i: F.col(name) if i else F.lit(1.0) - F.col(name)
            four = [F.struct((F.col("r") + i).alias("source_row"), (F.col("c") + j).alias("source_col"), (part("fr", i) * part("fc", j)).alias("weight")) for i in (0, 1) for j in (0, 1)]
            found = first.select(*key, F.inline(F.array(*four)))
    return found.where(F.col("weight") > LEAST_WEIGHT).select(*key, F.col("source_row").cast("int").alias("source_row"), F.col("source_col").cast("int").alias("source_col"), "weight")


def warp(source: DataFrame, source_grid: GridSpec, target_grid: GridSpec, method: str = "nearest", value: str = "value", keys: list[str] = (), block: int = 256) -> DataFrame:
    """grid_row, grid_col, `keys`, `value` of `source` (grid_row, grid_col, keys, value) on the target grid; a row for each target cell and key that has a value.

    nearest: the source cell that holds the target cell's centre. bilinear: the four source cells around it, by distance, for centres on the source grid. average: the source cells
    under the target cell, by the area that the envelope of its four mapped corners covers. NULL values are masked: they take no part, and a cell with none has no row.
    Several layers (tiles, bands, dates) go at once: `keys` tell them apart.
    """
    if method not in RESAMPLING:
        raise ValueError(f"method must be one of {', '.join(RESAMPLING)}, not {method!r}")
    blocks = target_blocks(source, source_grid, target_grid, block)
    along = lambda off, many: F.explode(F.sequence(F.col(off), F.col(off) + F.col(many) - 1).cast("array<int>"))
    cells = blocks.withColumn("grid_row", along("row_off", "rows")).withColumn("grid_col", along("col_off", "cols"))
    placed = _touches(cells, method, target_grid, source_grid)
    valid = source.where(F.col(value).isNotNull()).select(F.col("grid_row").alias("source_row"), F.col("grid_col").alias("source_col"), *keys, value)
    joined = placed.join(valid, ["source_row", "source_col"])
    if method == "nearest":
        return joined.select("grid_row", "grid_col", *keys, value)
    return joined.groupBy("grid_row", "grid_col", *keys).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value))


def warp_mosaic(tiles: DataFrame, tile_grid: GridSpec, target_grid: GridSpec, params: MosaicParams = MosaicParams()) -> DataFrame:
    """grid_row, grid_col, value, tile_ordinal: tiles (grid_row, grid_col, raw, tile_ordinal) of one grid brought onto the target by `params.resampling`, then merged by `params.prefer`."""
    return warp_layers([(tiles, tile_grid)], target_grid, params)


def warp_layers(layers: list[tuple[DataFrame, GridSpec]], target_grid: GridSpec, params: MosaicParams = MosaicParams()) -> DataFrame:
    """As warp_mosaic, for tiles of several grids and coordinate systems: a table (grid_row, grid_col, raw, tile_ordinal) and grid for each. Tiles are merged by ordinal, whatever grid they lie on.

    Validity is tested on raw values before they are resampled, so that no-data never mixes into a mean. One shuffle for each grid's join and one for the merge.
    """
    if not layers:
        raise ValueError("no tiles")
    valid = source_valid(params.nodata)(F.col("raw"))
    plain = [(t.where(valid).select("grid_row", "grid_col", "tile_ordinal", F.col("raw").cast("double").alias("raw")), g) for t, g in layers]
    warped = [warp(t, g, target_grid, params.resampling, "raw", ["tile_ordinal"]) for t, g in plain]
    return mosaic.merge(reduce(DataFrame.unionByName, warped), params, valid=lambda raw: raw.isNotNull())
