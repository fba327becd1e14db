"""Grids: affine transforms, nearest warping, sampling, blocks, overviews."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.sources.shared import shared_folder


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: x and y of the upper-left corner, cell sizes, columns and rows, and the value for empty cells."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    nodata: float | None = None
    crs: str = "EPSG:5070"

    def __post_init__(self) -> None:
        if self.dx <= 0 or self.dy <= 0 or self.width < 1 or self.height < 1:
            raise ValueError("cell sizes, width and height must be positive")

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x0) + (col + 0.5) * self.dx, F.lit(self.y0) - (row + 0.5) * self.dy

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, column) of the cell that holds a point, whether or not it lies on the grid."""
        return F.floor((F.lit(self.y0) - y) / self.dy).cast("int"), F.floor((x - F.lit(self.x0)) / self.dx).cast("int")

    def check(self, most: float = 1e13) -> None:
        if self.width * self.height > most:
            raise ValueError(f"{self.width} x {self.height} cells are more than {most:g}")


def cells(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """grid_row, grid_col of every cell."""
    ids = spark.range(grid.width * grid.height)
    return ids.select(F.floor(F.col("id") / grid.width).cast("int").alias("grid_row"), (F.col("id") % grid.width).cast("int").alias("grid_col"))


def warp_nearest(source: DataFrame, source_grid: GridSpec, target: DataFrame, target_grid: GridSpec) -> DataFrame:
    """`target` cells (grid_row, grid_col) with the columns of the source cell that holds their centre; cells off the source are left out."""
    x, y = target_grid.centre(F.col("grid_row"), F.col("grid_col"))
    row, col = source_grid.cell(x, y)
    placed = target.select("grid_row", "grid_col", row.alias("source_row"), col.alias("source_col"))
    placed = placed.where(F.col("source_row").between(0, source_grid.height - 1) & F.col("source_col").between(0, source_grid.width - 1))
    renamed = source.withColumnsRenamed({"grid_row": "source_row", "grid_col": "source_col"})
    return placed.join(renamed, ["source_row", "source_col"]).drop("source_row", "source_col")


def coarse_sample(pixels: DataFrame, every: int) -> DataFrame:
    """The middle cell of each `every` x `every` square: a sample at a coarser scale."""
    if every < 1:
        raise ValueError("every must be at least 1")
    return pixels.where((F.col("grid_row") % every == every // 2) & (F.col("grid_col") % every == every // 2))


def block_grid(spark: SparkSession, width: int, height: int, size: int = 512) -> DataFrame:
    """block_row, block_col, row_off, col_off, rows, cols of each block; blocks at the edges are clipped."""
    if size < 1:
        raise ValueError("block size must be positive")
    down, across = -(-height // size), -(-width // size)
    ids = spark.range(down * across)
    rows = ids.select(F.floor(F.col("id") / across).cast("int").alias("block_row"), (F.col("id") % across).cast("int").alias("block_col"))
    rows = rows.withColumns({"row_off": F.col("block_row") * size, "col_off": F.col("block_col") * size})
    return rows.withColumns({"rows": F.least(F.lit(size), F.lit(height) - F.col("row_off")), "cols": F.least(F.lit(size), F.lit(width) - F.col("col_off"))})


def overview(raster: DataFrame, factor: int, value: str = "value", scale: float = 1.0) -> DataFrame:
    """Means of `factor` x `factor` squares, empty cells left out: level, grid_row, grid_col, value."""
    return overview_pyramid(raster, [factor], value, scale)


def overview_pyramid(raster: DataFrame, factors: list[int], value: str = "value", scale: float = 1.0) -> DataFrame:
    """All levels: level, grid_row, grid_col, value (the mean of a square's cells times `scale`, empty cells left out).

    A level is built from the sums and counts of the last one whose factor divides its own, so each shuffle is a fraction of the one before it, and the finest level's are written to the checkpoint folder once. Sums of
    integers are exact: pass raw integers and their scale where means must not depend on the order of additions.
    """
    if min(factors) < 2:
        raise ValueError("factors must be at least 2")
    built: dict[int, DataFrame] = {}
    for factor in sorted(set(factors)):
        below = next((f for f in reversed(built) if factor % f == 0), None)
        step = factor // (below or 1)
        key = [F.floor(F.col(c) / step).cast("int").alias(c) for c in ("grid_row", "grid_col")]
        if below is None:
            sums = F.sum(value).alias("sum_"), F.count(value).alias("count_")
            shared_folder(raster.sparkSession)
            built[factor] = raster.groupBy(*key).agg(*sums).checkpoint()  # every level reads it: the raster itself is worked out once
        else:
            built[factor] = built[below].groupBy(*key).agg(F.sum("sum_").alias("sum_"), F.sum("count_").alias("count_"))
    mean = F.col("sum_").cast("double") / F.col("count_") * F.lit(scale)
    return reduce(DataFrame.unionByName, [found.select(F.lit(f).alias("level"), "grid_row", "grid_col", mean.alias(value)) for f, found in built.items()])
