"""Listing raster files in merge order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.operators.zonal import ranked


def extension_rank(path: Column) -> Column:
    """0 for .tif, 1 for .tiff, NULL for anything else: all .tif files come before any .tiff."""
    return F.when(path.endswith(".tif"), 0).when(path.endswith(".tiff"), 1)


def in_merge_order(paths: DataFrame) -> DataFrame:
    """path, ext_rank, tile_ordinal of the raster files in `paths`: sorted by extension, then by the parts of the path."""
    kept = paths.select("path", extension_rank(F.col("path")).alias("ext_rank")).where(F.col("ext_rank").isNotNull())
    return ranked(kept, [F.col("ext_rank"), F.split("path", "/")]).withColumnRenamed("ordinal", "tile_ordinal")


def list_tiles(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, ext_rank, tile_ordinal of the raster files in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.tif*").load(folder)
    return in_merge_order(files.select("path"))
