"""Zone membership from outlines: scanline cover of a grid, and lookups in it.

Each edge is cut by the grid rows whose centre lines it crosses. Along such a line the crossings of a zone, sorted, open and close intervals; an interval is a range of columns. Only
the two ends of an interval are compared with cell centres, so the work grows with rows crossed by edges and not with the cells inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrastack.operators.grid import GridSpec
from terrastack.sources.outlines import edges

#: Columns of a block: membership is looked up by (row, block of columns).
BLOCK_COLS = 512


def _first_cell(grid: GridSpec, x: Column) -> Column:
    """The first column whose centre is not left of x; the estimate by division is put right by comparing centres, so that rounding decides nothing."""
    centre = lambda col: grid.centre(F.lit(0), col)[0]
    guess = F.ceil((x - F.lit(grid.x0)) / grid.dx - 0.5).cast("long")
    return guess - (centre(guess - 1) >= x).cast("long") + (centre(guess) < x).cast("long")


def _first_row(grid: GridSpec, y: Column) -> Column:
    """The first row whose centre is below y, that is, less than it."""
    centre = lambda row: grid.centre(row, F.lit(0))[1]
    guess = F.ceil((F.lit(grid.y0) - y) / grid.dy - 0.5).cast("long")
    return guess - (centre(guess - 1) < y).cast("long") + (centre(guess) >= y).cast("long")


def crossings(outline: DataFrame, grid: GridSpec) -> DataFrame:
    """zone, grid_row, x: where the edges of `outline` (vertices) cross the centre lines of grid rows. An edge has its lower end but not its upper one."""
    cut = edges(outline).withColumns({"r0": F.greatest(_first_row(grid, F.col("y2")), F.lit(0)), "r1": F.least(_first_row(grid, F.col("y1")), F.lit(grid.height))})
    # centres with y1 <= y < y2: those below y2, without those below y1
    rows = cut.where("r0 < r1").withColumn("grid_row", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1).cast("array<int>")))
    y = grid.centre(F.col("grid_row"), F.lit(0))[1]
    return rows.select("zone", "grid_row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))


def cover(outline: DataFrame, grid: GridSpec) -> DataFrame:
    """zone, grid_row, col_from, col_to (inclusive): the cells whose centre lies in a zone, as intervals (even-odd rule: holes, and parts of a zone, are rings like any other).

    A centre on a shared edge belongs to the zone on its right; zones may overlap. One shuffle, by zone and row; a row of a zone holds as many crossings as edges meet its line.
    """
    line = W.partitionBy("zone", "grid_row").orderBy("x")
    paired = crossings(outline, grid).select("zone", "grid_row", "x", F.lead("x").over(line).alias("end"), F.row_number().over(line).alias("n")).where(F.col("n") % 2 == 1)
    spans = paired.select("zone", "grid_row", F.greatest(_first_cell(grid, F.col("x")), F.lit(0)).alias("col_from"), F.least(_first_cell(grid, F.col("end")) - 1, F.lit(grid.width - 1)).alias("col_to"))
    return spans.where("col_from <= col_to").select("zone", "grid_row", F.col("col_from").cast("int").alias("col_from"), F.col("col_to").cast("int").alias("col_to"))


def covered_cells(intervals: DataFrame) -> DataFrame:
    """zone, grid_row, grid_col of every covered cell: a membership table, made without reading a pixel."""
    return intervals.select("zone", "grid_row", F.explode(F.sequence("col_from", "col_to")).alias("grid_col"))


def members(pixels: DataFrame, intervals: DataFrame, block_cols: int = BLOCK_COLS) -> DataFrame:
    """`pixels` (grid_row, grid_col, ...) with the zone of each interval that holds them: a row for each zone, none for pixels outside.

    Joined by row and block of columns, so a pixel meets only the intervals of its own block; whether the intervals are broadcast goes by their size.
    """
    blocks = F.sequence(F.floor(F.col("col_from") / block_cols), F.floor(F.col("col_to") / block_cols))
    pieces = intervals.select("zone", "grid_row", "col_from", "col_to", F.explode(blocks).alias("block_"))
    placed = pixels.withColumn("block_", F.floor(F.col("grid_col") / block_cols))
    found = placed.join(pieces, ["grid_row", "block_"]).where(F.col("grid_col").between(F.col("col_from"), F.col("col_to")))
    return found.select(*pixels.columns, "zone")
