"""Mosaics that grow: new tiles change only the blocks that they touch.

The stored mosaic keeps, for each cell, the raw value that won and its tile's ordinal, in a folder for each block of cells. A batch reads the folders of its own blocks, merges by
ordinal and puts those folders in place of the old ones (dynamic partition overwrite), so tiles may come in any order of batches and other blocks keep their files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.functions.masks import source_valid
from terrastack.operators import mosaic
from terrastack.operators.raster_blocks import KEY, block_of
from terrastack.params import MosaicParams
from terrastack.sources.shared import shared_folder

#: Cells along a side of a folder's block: of a raster of 10^10 cells, some hundred folders.
FOLDER_CELLS = 8192
STORED = "grid_row int, grid_col int, raw double, tile_ordinal int, block_row int, block_col int"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, by Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def add_tiles(tiles: DataFrame, path: str, params: MosaicParams = MosaicParams(), size: int = FOLDER_CELLS) -> None:
    """Merges `tiles` (grid_row, grid_col, raw, tile_ordinal) into the mosaic at `path`, which is made if it isn't there.

    Ordinals tell tiles of all batches apart: the last one ('src') or the first ('dest') wins, whichever batch brought it, and a tile given again changes nothing. A batch without valid cells
    writes nothing. The merged blocks are written to the shared folder before they replace what they were read from; if a job ends in between, adding the batch again puts things right.
    """
    spark = tiles.sparkSession
    fresh = tiles.where(source_valid(params.nodata)(F.col("raw"))).select("grid_row", "grid_col", F.col("raw").cast("double").alias("raw"), F.col("tile_ordinal").cast("int").alias("tile_ordinal"), *block_of(size))
    if _exists(spark, path):
        touched = fresh.select(*KEY).distinct()  # some hundred folders at most, so Spark prunes by them at run time
        fresh = fresh.unionByName(stored(spark, path).join(touched, KEY).select(*fresh.columns))
    # the tile's ordinal decides among equal ones too: the larger raw value
    pick = F.max_by if params.prefer == "src" else F.min_by
    best = fresh.groupBy(*KEY, "grid_row", "grid_col").agg(pick("raw", F.struct("tile_ordinal", "raw")).alias("raw"), (F.max if params.prefer == "src" else F.min)("tile_ordinal").alias("tile_ordinal"))
    step = f"{shared_folder(spark)}/increment-{uuid.uuid4().hex}"
    best.write.parquet(step)
    ready = spark.read.parquet(step).hint("rebalance", *KEY)
    ready.select("grid_row", "grid_col", "raw", "tile_ordinal", *KEY).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*KEY).parquet(path)


def current(spark: SparkSession, path: str, params: MosaicParams = MosaicParams()) -> DataFrame:
    """grid_row, grid_col, value, tile_ordinal of the mosaic as it is."""
    return mosaic.merge(stored(spark, path), params, valid=lambda raw: raw.isNotNull())
