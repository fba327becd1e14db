"""The three end-to-end jobs: monthly retrieval composites, density tables, file mosaics."""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.functions.landcover import is_vegetated, with_land_cover
from terrastack.functions.spectral import rename_bands
from terrastack.operators import composite, density, grid, mosaic, quality_flags, retrieval
from terrastack.params import CompositeParams, DensityParams, MosaicParams
from terrastack.schemas import FEATURES
from terrastack.sources import catalog, geotiff, tiles
from terrastack.sources.shared import shared_folder


def retrievals(scenes: DataFrame, obs: DataFrame, pixels: DataFrame, cover: DataFrame, hull: DataFrame, models: dict[tuple[str, int], RandomForestRegressionModel], start: str, end: str, params: CompositeParams = CompositeParams(), features: list[str] = FEATURES) -> DataFrame:
    """pixel_id, scene_id, time_start, biome, lai (encoded), qa of every clear observation from `start` on, before `end`.

    scenes: the catalog. obs: scene_id, pixel_id, sr_b1 to sr_b7, qa_pixel. pixels: pixel_id, lon, lat (and whatever should stay). cover: pixel_id, epoch,
    release_rank, landcover. hull: sensor, hull_index, in_hull. models: one for each (sensor, biome).
    """
    kept = catalog.catalog(scenes, start, end, params.cloud_limit)
    named = rename_bands(obs.join(kept.select("scene_id", "spacecraft_id"), "scene_id"), ["green", "red", "nir", "swir1"]).drop("spacecraft_id")
    clear = retrieval.clear_observations(named, kept, prefix="")
    placed = with_land_cover(retrieval.feature_table(clear, pixels), cover)
    found = retrieval.retrieve(placed, models, params.nonveg, features)
    flagged = quality_flags.with_hull(found, hull, ["sensor"])
    flags = quality_flags.quality_flags(F.col("lai_real"), F.col("in_hull"), F.col("biome"))
    return flagged.where(F.col("lai_real").isNotNull()).select("pixel_id", "scene_id", "time_start", "biome", quality_flags.encode(F.col("lai_real"), params.encode_scale).alias("lai"), flags.alias("qa"))


def monthly_composites(found: DataFrame, pixels: DataFrame, months: list[tuple[int, int]], state: str, params: CompositeParams = CompositeParams()) -> DataFrame:
    """One row for each pixel and month asked for, with the composite's properties and export name: all months in one plan."""
    dense = composite.monthly_dense(found, pixels, months, params)
    named = composite.properties(F.col("year"), F.col("month"), F.lit(state), params)
    extra = {n: c for n, c in named.items() if n not in ("year", "month")}
    return dense.withColumns(extra).withColumn("name", composite.export_name(F.lit(state), F.col("year"), F.col("month")))


def density_tables(scenes: DataFrame, obs: DataFrame, pixels: DataFrame, membership: DataFrame, params: DensityParams = DensityParams(), placeholder: str | None = None) -> dict[str, DataFrame]:
    """monthly_obs_stats, regional_obs_stats and gap_fraction from one persisted table of mean counts; call unpersist on `mean` when done.

    pixels: pixel_id, state, landcover. Gap fractions are taken over vegetated pixels.
    """
    clear = density.clear_rows(obs, scenes, params, placeholder)
    mean = density.mean_obs_count(clear, pixels.withColumn("is_veg", is_vegetated(F.col("landcover"))), params).persist()
    return {
        "mean": mean,
        "monthly_obs_stats": density.monthly_obs_stats(mean),
        "regional_obs_stats": density.regional_obs_stats(mean, membership),
        "gap_fraction": density.gap_fraction(mean, mask=F.col("is_veg") == 1),
    }


def mosaic_files(spark: SparkSession, folder: str, target: grid.GridSpec, out: str, params: MosaicParams = MosaicParams(), options: geotiff.TiffOptions = geotiff.TiffOptions(), recursive: bool = True) -> DataFrame:
    """Merges the GeoTIFFs of a folder, in file order, onto `target`, writes the result to `out` and returns its cells.

    Files may lie on other grids of the same coordinates: each target cell takes the source cell that holds its centre. A file that names another
    coordinate system is an error (one that names none is taken to have the target's); so is a folder without files.
    """
    if params.resampling != "nearest":
        raise ValueError(f"files are merged by nearest cells; operators.warp.warp_layers does {params.resampling} on tables")
    order = tiles.list_tiles(spark, folder, recursive)
    if order.isEmpty():
        raise FileNotFoundError(f"no .tif or .tiff file in {folder}")
    # NaN and infinities are never values; the declared nodata is tested on raw values, before scaling
    same = F.col("crs").isin(target.crs, "EPSG:0")
    refused = F.raise_error(F.concat(F.col("path"), F.lit(" has the coordinates of "), F.col("crs"), F.lit(f", not {target.crs}"))).cast("boolean")
    # the files' order is joined to blocks, not to cells
    blocks = geotiff.read_blocks(spark, folder, None, recursive).where(F.when(same, F.lit(True)).otherwise(refused)).join(order.select("path", "tile_ordinal"), "path")
    first_row, first_col = (F.ceil(x - 0.5 - 1e-9).cast("int") for x in ((F.lit(target.y0) - F.col("y")) / target.dy, (F.col("x") - F.lit(target.x0)) / target.dx))
    last_row = F.ceil((F.lit(target.y0) - F.col("y") + F.col("rows") * F.col("dy")) / target.dy - 0.5 - 1e-9).cast("int") - 1
    last_col = F.ceil((F.col("x") + F.col("cols") * F.col("dx") - F.lit(target.x0)) / target.dx - 0.5 - 1e-9).cast("int") - 1
    spans = blocks.withColumns({"r0": F.greatest(first_row, F.lit(0)), "r1": F.least(last_row, F.lit(target.height - 1)), "c0": F.greatest(first_col, F.lit(0)), "c1": F.least(last_col, F.lit(target.width - 1))})
    spans = spans.where((F.col("r0") <= F.col("r1")) & (F.col("c0") <= F.col("c1")))
    rows = spans.withColumn("grid_row", F.explode(F.sequence("r0", "r1"))).withColumn("grid_col", F.explode(F.sequence("c0", "c1")))
    x, y = target.centre(F.col("grid_row"), F.col("grid_col"))
    down = F.least(F.floor((F.col("y") - y) / F.col("dy")).cast("int"), F.col("rows") - 1)
    across = F.least(F.floor((x - F.col("x")) / F.col("dx")).cast("int"), F.col("cols") - 1)
    placed = rows.select("tile_ordinal", "grid_row", "grid_col", F.get("cells", down * F.col("cols") + across).cast("double").alias("raw"))
    shared_folder(spark)
    merged = mosaic.merge(placed, params).select("grid_row", "grid_col", "value").checkpoint()  # read by the writer and by the caller
    geotiff.write(geotiff.encode(merged, target, options, "mosaic"), out)
    return merged
