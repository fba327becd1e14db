"""Rasters as blocks: one row for each square of cells, its values an array, in tables bucketed by block.

Two such tables of one layout (size and number of buckets) are joined where they lie: mosaics, overviews and statistics of whole blocks need no shuffle. Blocks at the edges are clipped.
Whole blocks are what a job on rasters of 10^10 cells moves: 10^5 rows instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.operators.grid import GridSpec

KEY = ["block_row", "block_col"]
#: Cells along a side, and buckets of a table.
SIZE, BUCKETS = 512, 64
BLOCK = "block_row int, block_col int, rows int, cols int, cells array<double>"


def shape(grid: GridSpec, size: int) -> dict[str, Column]:
    """rows and cols of a block: `size`, or less at the lower and right edges."""
    return {"rows": F.least(F.lit(size), F.lit(grid.height) - F.col("block_row") * size), "cols": F.least(F.lit(size), F.lit(grid.width) - F.col("block_col") * size)}


def block_of(size: int) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("int").alias(k) for c, k in (("grid_row", "block_row"), ("grid_col", "block_col"))]


def to_blocks(cells: DataFrame, grid: GridSpec, value: str = "value", size: int = SIZE) -> DataFrame:
    """BLOCK rows of `cells` (grid_row, grid_col, value); cells off the grid are left out, absent ones are NULL; of a cell that is there twice the larger value counts.

    One shuffle by block. A block of 512 x 512 holds 262,144 values, so a task has some megabytes at a time.
    """
    width, height = grid.width, grid.height

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * size, key[1].as_py() * size
        rows, cols = min(size, height - top), min(size, width - left)
        at = (table.column("grid_row").to_numpy() - top) * cols + table.column("grid_col").to_numpy() - left
        values = np.full(rows * cols, -np.inf)
        np.maximum.at(values, at, table.column("v").to_numpy())
        held = pa.array(values, mask=np.isneginf(values))
        array = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), held)
        return pa.Table.from_arrays([*[pa.array([k.as_py()], pa.int32()) for k in key], pa.array([rows], pa.int32()), pa.array([cols], pa.int32()), array], names=[*KEY, "rows", "cols", "cells"])

    inside = cells.where(F.col("grid_row").between(0, height - 1) & F.col("grid_col").between(0, width - 1) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    placed = inside.select(*block_of(size), F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_col").cast("int").alias("grid_col"), F.col(value).cast("double").alias("v"))
    return placed.groupBy(*KEY).applyInArrow(fill, BLOCK)


def to_cells(blocks: DataFrame, size: int = SIZE, value: str = "value") -> DataFrame:
    """grid_row, grid_col, value of the cells that are there."""
    flat = blocks.select(*KEY, "cols", F.posexplode("cells").alias("at", value)).where(F.col(value).isNotNull())
    row, col = F.col("block_row") * size + F.floor(F.col("at") / F.col("cols")), F.col("block_col") * size + F.col("at") % F.col("cols")
    return flat.select(row.cast("int").alias("grid_row"), col.cast("int").alias("grid_col"), value)


def save(blocks: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Stores blocks bucketed by their key under `path` and gives them back as read from there.

    Buckets are known by a catalog entry only; it is dropped once the returned frame knows its files, so the files are all that stays. Use `name` for an entry of your own choosing.
    """
    spark = blocks.sparkSession
    blocks.repartition(buckets, *KEY).write.mode("errorifexists").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    return spark.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Drops the catalog entry; the files, and frames that were read from it, stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def merge(below: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the value of `above` in each cell, where it has one, else that of `below`: the last layer wins; swap them for the first.

    Blocks of tables of one layout are joined bucket by bucket, without a shuffle. Results that are merged further are stored by `save` in between.
    """
    named = [layer.select(*KEY, F.struct("rows", "cols", "cells").alias(name)) for layer, name in ((below, "b"), (above, "a"))]
    joined = named[0].join(named[1], KEY, "full_outer")
    a, b = F.col("a.cells"), F.col("b.cells")
    cells = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)))
    return joined.select(*KEY, F.coalesce("a.rows", "b.rows").alias("rows"), F.coalesce("a.cols", "b.cols").alias("cols"), cells.alias("cells"))


def statistics(blocks: DataFrame) -> DataFrame:
    """count, total, least and largest value of each block, where it lies."""
    held = F.filter("cells", lambda v: v.isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
    return blocks.select(*KEY, F.size(held).alias("count"), total.alias("total"), F.array_min(held).alias("least"), F.array_max(held).alias("largest"))


def overview(blocks: DataFrame, factor: int, size: int = SIZE) -> DataFrame:
    """grid_row, grid_col, value: means of `factor` x `factor` cells. `factor` divides `size`, so no square lies in two blocks and nothing is shuffled."""
    if factor < 2 or size % factor:
        raise ValueError(f"{factor} does not divide blocks of {size}")

    def means(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for top, left, rows, cols, cells in zip(*(batch.column(c) for c in (*KEY, "rows", "cols", "cells")), strict=True):
                r, c = rows.as_py(), cols.as_py()
                values = np.full((-(-r // factor) * factor, -(-c // factor) * factor), np.nan)
                values[:r, :c] = cells.values.to_numpy(zero_copy_only=False).reshape(r, c)
                squares = values.reshape(values.shape[0] // factor, factor, -1, factor)
                count = (~np.isnan(squares)).sum((1, 3))
                at = np.nonzero(count)
                out[0] += (at[0] + top.as_py() * size // factor).tolist()
                out[1] += (at[1] + left.as_py() * size // factor).tolist()
                out[2] += (np.nansum(squares, (1, 3))[at] / count[at]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], names=["grid_row", "grid_col", "value"])

    return blocks.mapInArrow(means, "grid_row int, grid_col int, value double")
