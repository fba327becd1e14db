"""Registered queries over the raster-shaped views, and the same in SQL.

Each runs an operator over its whole tables. Doubles are rounded to six places, since sums of another order differ in the last ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.functions import landcover, masks, projection, spectral
from terrastack.operators import composite, density, footprints, grid, increments, mosaic, outlines, quality_flags, raster_blocks, retrieval, sketches, warp, zonal
from terrastack.params import CompositeParams, DensityParams, ForestParams, MosaicParams
from terrastack.plans.views import oracle, view
from terrastack.schemas import FEATURES, LABEL, epoch_by_year
from terrastack.sources import catalog, geotiff, partitioned, tiles
from terrastack.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
YEARS = DensityParams(1995, 2000)
GRID = grid.GridSpec(x0=0.0, y0=300.0, dx=30.0, dy=30.0, width=20, height=10, nodata=-9999.0)
#: The grid that tiles are warped to: shifted, and with larger cells.
COARSE = grid.GridSpec(x0=15.0, y0=310.0, dx=45.0, dy=45.0, width=14, height=7)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = oracle(sql)
        return run

    return register


def six(column: str | Column, name: str | None = None) -> Column:
    found = F.col(column) if isinstance(column, str) else column
    return F.round(found, 6).alias(name or column)


def clear_refl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear observations of scenes below the cloud limit, with reflectances, indices and angles."""
    scenes = catalog.filter_cloud(view(spark, sf_dir, "scenes"))
    return retrieval.clear_observations(view(spark, sf_dir, "obs"), scenes)


def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear observations with biome, a deterministic LAI in the forest's place, its hull test, flags and code."""
    found = retrieval.feature_table(clear_refl(spark, sf_dir), view(spark, sf_dir, "pixels").select("pixel_id", "biome"))
    found = quality_flags.with_hull(found.withColumn("lai_real", F.lit(3.0) + F.lit(9.0) * F.col("NDVI")), view(spark, sf_dir, "hull"))
    flags = quality_flags.quality_flags(F.col("lai_real"), F.col("in_hull"), F.col("biome"))
    return found.withColumn("qa", flags).withColumn("lai", quality_flags.encode(F.col("lai_real"))).where(F.col("lai_real").isNotNull())


def clear_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.clear_rows(view(spark, sf_dir, "obs"), view(spark, sf_dir, "scenes"), YEARS)


def mean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "pixels").select("pixel_id", "grid_row", "grid_col", "state_key", "is_veg")
    return density.mean_obs_count(clear_rows(spark, sf_dir), pixels, YEARS)


def ordered_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile cells with their tile's place in the order of names."""
    found = view(spark, sf_dir, "tiles")
    order = zonal.ranked(found.select("tile").distinct(), [F.col("tile")]).withColumnRenamed("ordinal", "tile_ordinal")
    placed = found.withColumns({"grid_row": F.floor(F.col("pixel_id") / 20).cast("int"), "grid_col": (F.col("pixel_id") % 20).cast("int")})
    return placed.join(order, "tile")


# Catalog and zones


@query("""SELECT scene_id, spacecraft_id, CAST(substring(spacecraft_id, 9, 1) AS INT) AS spacecraft_no,
 CASE substring(spacecraft_id, 9, 1) WHEN '5' THEN 'LT05' WHEN '7' THEN 'LE07' ELSE 'LC08' END AS sensor, round(cloud_cover, 6) AS cloud_cover, time_start
 FROM {scenes} WHERE time_start >= TIMESTAMP '1997-06-01' AND time_start < TIMESTAMP '1997-07-01' AND cloud_cover < 50""")
def scene_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.catalog(view(spark, sf_dir, "scenes"), "1997-06-01", "1997-07-01")
    return found.select("scene_id", "spacecraft_id", "spacecraft_no", "sensor", six("cloud_cover"), "time_start").orderBy("time_start", "scene_id")


@query("""SELECT s.scene_id, s.time_start FROM {scenes} s WHERE EXISTS (SELECT 1 FROM {obs} o JOIN {pixels} p ON o.pixel_id = p.pixel_id
 WHERE o.scene_id = s.scene_id AND p.state_key IN (3, 4))""")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = view(spark, sf_dir, "pixels").where(F.col("state_key").isin(3, 4)).select("pixel_id")
    footprints = view(spark, sf_dir, "obs").select("scene_id", "pixel_id").join(region, "pixel_id", "left_semi")
    return catalog.filter_bounds(view(spark, sf_dir, "scenes"), footprints).select("scene_id", "time_start")


@query("SELECT pixel_id, state_key FROM {pixels} WHERE state_key NOT IN (0, 1, 2, 5, 8, 13, 21)")
def zone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.keep_zones(view(spark, sf_dir, "pixels"), "state_key", [0, 1, 2, 5, 8, 13, 21]).select("pixel_id", "state_key")


@query("""SELECT i AS zone_index, codes[least(greatest(i, 0), len(codes) - 1) + 1] AS n_name FROM (SELECT list(n_name ORDER BY n_name) AS codes FROM nation),
 (VALUES (-5), (3), (99)) AS t(i)""")
def zone_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = view(spark, sf_dir, "nation")
    picked = [zonal.pick_zone(codes, i, code="n_name").select(F.lit(i).alias("zone_index"), "n_name") for i in (-5, 3, 99)]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


@query("""SELECT state_key, min(grid_col) * 30e0 AS xmin, min(grid_row) * 30e0 AS ymin, max(grid_col) * 30e0 AS xmax, max(grid_row) * 30e0 AS ymax
 FROM {pixels} GROUP BY state_key""")
def zone_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = view(spark, sf_dir, "pixels").withColumns({"x": F.col("grid_col") * 30.0, "y": F.col("grid_row") * 30.0})
    return zonal.bounds(placed, ["state_key"])


@query("""SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month, CAST(make_date(y, m, 1) AS TIMESTAMP) AS month_start, CAST(make_date(y, m, 1) + INTERVAL 1 MONTH AS TIMESTAMP) AS month_end, n AS scenes
 FROM (SELECT year(time_start) AS y, month(time_start) AS m, count(*) AS n FROM {scenes} GROUP BY ALL)""")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month that has scenes, with its bounds."""
    months = view(spark, sf_dir, "scenes").groupBy(F.year("time_start").alias("year"), F.month("time_start").alias("month")).agg(F.count(F.lit(1)).alias("scenes"))
    start = F.make_date("year", "month", F.lit(1))
    return months.select("year", "month", start.cast("timestamp_ntz").alias("month_start"), F.add_months(start, 1).cast("timestamp_ntz").alias("month_end"), "scenes")


@query("""SELECT CAST(floor(grid_row / 8) AS INT) AS block_row, CAST(floor(grid_col / 8) AS INT) AS block_col, CAST(least(8, 10 - floor(grid_row / 8) * 8) AS INT) AS rows, CAST(least(8, 20 - floor(grid_col / 8) * 8) AS INT) AS cols,
 count(*) AS cells, CAST(sum(is_veg) AS BIGINT) AS vegetated FROM {pixels} GROUP BY ALL""")
def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that hold pixels, clipped at the edges of the grid."""
    found = view(spark, sf_dir, "pixels").groupBy(*raster_blocks.block_of(8)).agg(F.count(F.lit(1)).alias("cells"), F.sum("is_veg").alias("vegetated"))
    shape = raster_blocks.shape(GRID, 8)
    return found.select("block_row", "block_col", *[c.cast("int").alias(n) for n, c in shape.items()], "cells", "vegetated")


# Scene search

_MEET = "f.xmin <= z.xmax AND z.xmin <= f.xmax AND f.ymin <= z.ymax AND z.ymin <= f.ymax"
_ZONE_BOXES = "(SELECT zone, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {outlines} GROUP BY zone) z"


@query(f"SELECT f.scene_id, z.zone FROM {{footprints}} f JOIN {_ZONE_BOXES} ON {_MEET}")
def footprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scene with the zones whose box its footprint meets."""
    zones = zonal.bounds(view(spark, sf_dir, "outlines"), ["zone"])
    return footprints.overlapping(view(spark, sf_dir, "footprints"), zones, 64.0).select("a.scene_id", "b.zone")


@query(f"SELECT scene_id, time_start FROM {{scenes}} WHERE scene_id IN (SELECT f.scene_id FROM {{footprints}} f JOIN {_ZONE_BOXES} ON {_MEET} WHERE z.zone IN (3, 4)) AND cloud_cover < 50")
def footprint_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of two zones by their footprints: no observation is read."""
    zones = zonal.bounds(view(spark, sf_dir, "outlines").where(F.col("zone").isin(3, 4)), ["zone"])
    kept = catalog.filter_cloud(view(spark, sf_dir, "scenes"))
    return footprints.scenes_meeting(kept, view(spark, sf_dir, "footprints"), zones, 64.0).select("scene_id", "time_start")


@query("""SELECT s.scene_id, w.sensor, w.year, w.month FROM (SELECT scene_id, CASE substring(spacecraft_id, 9, 1) WHEN '5' THEN 'LT05' WHEN '7' THEN 'LE07' ELSE 'LC08' END AS sensor, time_start FROM {scenes}) s
 JOIN (SELECT DISTINCT * FROM {wanted}) w ON s.sensor = w.sensor AND year(s.time_start) = w.year AND month(s.time_start) = w.month""")
def catalog_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog in folders by sensor, year and month; a table of wanted months says which folders are read."""
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    partitioned.write_catalog(view(spark, sf_dir, "scenes"), path)
    return partitioned.scenes_of(spark.read.parquet(path), view(spark, sf_dir, "wanted")).select("scene_id", "sensor", "year", "month")


# Outlines


@query("SELECT zone, pixel_id, grid_row, grid_col FROM {zone_cells}")
def zone_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel with the zones whose outline holds its centre."""
    intervals = outlines.cover(view(spark, sf_dir, "outlines"), GRID)
    return outlines.members(view(spark, sf_dir, "pixels"), intervals, 8).select("zone", "pixel_id", "grid_row", "grid_col")


@query("SELECT zone, count(*) AS cells, CAST(min(grid_row) AS INT) AS first_row, CAST(max(grid_row) AS INT) AS last_row, CAST(sum(grid_col) AS BIGINT) AS columns_total FROM {zone_cells} GROUP BY zone")
def zone_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and place of each zone, from its intervals alone."""
    width = F.col("col_to") - F.col("col_from") + 1
    total = (F.col("col_from") + F.col("col_to")) * width / 2
    found = outlines.cover(view(spark, sf_dir, "outlines"), GRID).groupBy("zone")
    return found.agg(F.sum(width).alias("cells"), F.min("grid_row").alias("first_row"), F.max("grid_row").alias("last_row"), F.sum(total).cast("long").alias("columns_total"))


@query("""SELECT region, count(*) AS pixels, CAST(sum(is_veg) AS BIGINT) AS vegetated FROM (SELECT DISTINCT r.region, z.pixel_id, z.is_veg FROM {zone_cells} z JOIN {region_states} r ON z.zone = r.state_key) GROUP BY region""")
def region_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as unions of their zones' outlines, which overlap in parts: each pixel counts once in a region."""
    held = outlines.members(view(spark, sf_dir, "pixels").select("pixel_id", "grid_row", "grid_col", "is_veg"), outlines.cover(view(spark, sf_dir, "outlines"), GRID))
    regions = zonal.dissolve(held.select("pixel_id", F.col("zone").alias("state_key")), view(spark, sf_dir, "region_states"), "state_key")
    counted = regions.join(view(spark, sf_dir, "pixels").select("pixel_id", "is_veg"), "pixel_id")
    return counted.groupBy("region").agg(F.count(F.lit(1)).alias("pixels"), F.sum("is_veg").alias("vegetated"))


# Bands, masks, indices


@query("""SELECT o.scene_id, o.pixel_id, CASE WHEN n >= 8 THEN sr_b2 ELSE sr_b1 END AS blue, CASE WHEN n >= 8 THEN sr_b3 ELSE sr_b2 END AS green,
 CASE WHEN n >= 8 THEN sr_b4 ELSE sr_b3 END AS red, CASE WHEN n >= 8 THEN sr_b5 ELSE sr_b4 END AS nir, CASE WHEN n >= 8 THEN sr_b6 ELSE sr_b5 END AS swir1, sr_b7 AS swir2
 FROM {raw_obs} o JOIN (SELECT scene_id, CAST(substring(spacecraft_id, 9, 1) AS INT) AS n FROM {scenes}) s ON o.scene_id = s.scene_id""")
def band_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = view(spark, sf_dir, "raw_obs").join(view(spark, sf_dir, "scenes").select("scene_id", "spacecraft_id"), "scene_id")
    return spectral.rename_bands(joined).select("scene_id", "pixel_id", "blue", "green", "red", "nir", "swir1", "swir2")


@query("SELECT scene_id, pixel_id, CASE WHEN (qa_pixel & 152) = 0 THEN dn_red END AS dn_red FROM {obs}")
def qa_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs")
    return obs.select("scene_id", "pixel_id", masks.masked(F.col("dn_red"), masks.clear_sky(F.col("qa_pixel"))).alias("dn_red"))


@query("SELECT scene_id, coalesce(90e0 - sun_elevation, solar_zenith_angle, 45e0) AS sun_zenith, 180e0 AS sun_azimuth FROM {scenes}")
def solar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.solar_geometry(view(spark, sf_dir, "scenes")).select("scene_id", "sun_zenith", "sun_azimuth")


@query("""SELECT scene_id, pixel_id, round(green, 6) AS green, round(red, 6) AS red, round(nir, 6) AS nir, round(swir1, 6) AS swir1,
 round((nir - red) / nullif(nir + red, 0), 6) AS "NDVI", round((nir - swir1) / nullif(nir + swir1, 0), 6) AS "NDWI" FROM {refl}""")
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clear_refl(spark, sf_dir).select("scene_id", "pixel_id", *[six(c) for c in ("green", "red", "nir", "swir1", "NDVI", "NDWI")])


@query("""SELECT l.scene_id, l.pixel_id, l.hull_index, coalesce(h.in_hull, 0) AS in_hull FROM {lai} l LEFT JOIN {hull} h ON l.hull_index = h.hull_index""")
def hull_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = clear_refl(spark, sf_dir).join(view(spark, sf_dir, "pixels").select("pixel_id"), "pixel_id")
    return quality_flags.with_hull(placed, view(spark, sf_dir, "hull")).select("scene_id", "pixel_id", "hull_index", "in_hull")


# Land cover


@query("""SELECT s.scene_id, CAST(year(s.time_start) AS INT) AS year, CAST(CASE WHEN year(s.time_start) <= 2002 THEN 2001 WHEN year(s.time_start) <= 2005 THEN 2004 END AS INT) AS epoch FROM {scenes} s""")
def landcover_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.broadcast(epoch_by_year(spark))  # 41 rows
    return view(spark, sf_dir, "scenes").select("scene_id", F.year("time_start").alias("year")).join(years, "year", "left").select("scene_id", "year", "epoch")


@query("""SELECT p.pixel_id, f.epoch, f.landcover, m.biome, m.is_veg FROM {pixels} p JOIN (SELECT pixel_id, epoch, arg_min(landcover, release_rank) AS landcover FROM {cover} GROUP BY ALL) f
 ON p.pixel_id = f.pixel_id LEFT JOIN {class_map} m ON f.landcover = m.landcover""")
def biome_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = landcover.first_release(view(spark, sf_dir, "cover"))
    joined = view(spark, sf_dir, "pixels").select("pixel_id").join(first, "pixel_id")
    return joined.select("pixel_id", "epoch", "landcover", landcover.biome_of_class(F.col("landcover")).alias("biome"), landcover.is_vegetated(F.col("landcover")).alias("is_veg"))


# Retrieval


@query("SELECT scene_id, pixel_id, qa, CAST((qa & 3) = 0 AS INT) AS valid FROM {lai_qa}")
def lai_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir).select("scene_id", "pixel_id", "qa", masks.qa_valid(F.col("qa")).cast("int").alias("valid"))


@query("SELECT scene_id, pixel_id, lai, round(lai * 0.01e0, 6) AS decoded FROM {lai_qa}")
def lai_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir).select("scene_id", "pixel_id", "lai", six(quality_flags.decode(F.col("lai")), "decoded"))


@query("""SELECT r.scene_id, r.pixel_id, p.biome, round(sun_zenith, 6) AS sun_zenith, 180e0 AS sun_azimuth, round((nir - red) / nullif(nir + red, 0), 6) AS "NDVI", 0 AS constant
 FROM {refl} r JOIN {pixels} p ON r.pixel_id = p.pixel_id""")
def retrieval_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.feature_table(clear_refl(spark, sf_dir), view(spark, sf_dir, "pixels").select("pixel_id", "biome"))
    return found.select("scene_id", "pixel_id", "biome", six("sun_zenith"), "sun_azimuth", six("NDVI"), F.lit(0).alias("constant"))


_S = "sin(radians(lat))"
_Q = f"((1 - e2) * ({_S} / (1 - e2 * {_S} * {_S}) - ln((1 - sqrt(e2) * {_S}) / (1 + sqrt(e2) * {_S})) / (2 * sqrt(e2))))"


@query(f"""WITH k AS (SELECT 0.60290276906576e0 AS n, 1.3491820315609704e0 AS c, 9928937.004248783e0 AS r0, 6378137e0 AS a, (1 / 298.257222101e0) * (2 - 1 / 298.257222101e0) AS e2),
 p AS (SELECT pixel_id, -100e0 + 0.37 * grid_col AS lon, 30e0 + 0.61 * grid_row AS lat FROM {{pixels}}),
 r AS (SELECT pixel_id, lon, lat, n, r0, a * sqrt(c - n * {_Q}) / n AS rho FROM p CROSS JOIN k)
 SELECT pixel_id, round(rho * sin(n * radians(lon + 96)), 4) AS x, round(r0 - rho * cos(n * radians(lon + 96)), 4) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM r""")
def grid_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres and back: lon and lat are what the inverse gives."""
    placed = view(spark, sf_dir, "pixels").select("pixel_id", (F.lit(-100.0) + F.col("grid_col") * 0.37).alias("a"), (F.lit(30.0) + F.col("grid_row") * 0.61).alias("b"))
    x, y = projection.to_albers(F.col("a"), F.col("b"))
    metres = placed.select("pixel_id", x.alias("x"), y.alias("y"))
    lon, lat = projection.to_lonlat(F.col("x"), F.col("y"))
    return metres.select("pixel_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), six(lon, "lon"), six(lat, "lat"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: the stand-in LAI as label."""
    sensor = view(spark, sf_dir, "scenes").select("scene_id", catalog.sensor_code(F.col("spacecraft_id")).alias("sensor"))
    found = stand_in(spark, sf_dir).join(sensor, "scene_id")
    return found.withColumns({"biome2": F.col("biome"), "MCD_LAI": F.col("lai_real")})


def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clear observation with all ten features, lon and lat from the grid, and the stand-in LAI as label."""
    placed = view(spark, sf_dir, "pixels").select("pixel_id", (F.lit(-100.0) + F.col("grid_col") * 0.37).alias("lon"), (F.lit(30.0) + F.col("grid_row") * 0.61).alias("lat"))
    return _samples(spark, sf_dir).drop("lai_real", "lon", "lat").join(placed, "pixel_id")


@query()
def rf_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clear observation with the value of the default forest of its (sensor, biome)."""
    rows = forest_rows(spark, sf_dir).select("scene_id", "pixel_id", "sensor", "biome", *FEATURES, LABEL)
    kept = retrieval.keep_by_key(rows, ["sensor", "biome"])  # both training and retrieval read these files
    keys = sorted((r.sensor, r.biome) for r in kept.where(F.col(LABEL).isNotNull()).select("sensor", "biome").distinct().collect())  # 27 at most
    models = retrieval.train_kept(kept.withColumn("biome2", F.col("biome")), keys, ForestParams())
    return retrieval.retrieve_kept(kept, models, nonveg=True).select("scene_id", "pixel_id", six("lai_real"), six(LABEL))


@query("""SELECT scene_id, pixel_id, round(CASE biome WHEN 1 THEN lai_real WHEN 5 THEN lai_real + 1 WHEN 8 THEN CASE WHEN lai_real > 2 THEN lai_real END END, 6) AS chosen FROM {lai}""")
def lai_select_biome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of candidates for biomes 1, 5 and 8 the one of each row's biome; a masked candidate, or none, leaves NULL."""
    found = retrieval.feature_table(clear_refl(spark, sf_dir), view(spark, sf_dir, "pixels").select("pixel_id", "biome"))
    value = F.lit(3.0) + F.lit(9.0) * F.col("NDVI")
    found = found.withColumns({"b1": value, "b5": value + 1, "b8": F.when(value > 2, value)})
    return retrieval.select_by_biome(found, {1: "b1", 5: "b5", 8: "b8"}, "chosen").select("scene_id", "pixel_id", six("chosen"))


# Composites

_KEYS = "pixel_id, CAST(year(time_start) AS INT) AS year, CAST(month(time_start) AS INT) AS month"
_VALID = "FROM {lai_qa} WHERE (qa & 3) = 0 AND biome > 0 GROUP BY ALL"


@query(f"SELECT {_KEYS}, CAST(floor(median(lai)) AS INT) AS lai, count(*) AS obs_count {_VALID}")
def monthly_composite_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.monthly(stand_in(spark, sf_dir))


@query(f"SELECT {_KEYS}, CAST(floor(avg(lai)) AS INT) AS lai, count(*) AS obs_count {_VALID}")
def monthly_composite_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.monthly(stand_in(spark, sf_dir), CompositeParams(reducer="mean"))


@query(f"SELECT {_KEYS}, count(*) AS obs_count FROM {{lai_qa}} WHERE (qa & 3) = 0 GROUP BY ALL")
def composite_obs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.monthly(stand_in(spark, sf_dir), CompositeParams(nonveg=True)).select("pixel_id", "year", "month", "obs_count")


@query(f"""WITH c AS (SELECT {_KEYS}, CAST(floor(median(lai)) AS INT) AS lai, count(*) AS obs_count {_VALID})
 SELECT p.pixel_id, t.year, t.month, c.lai, coalesce(c.obs_count, 0) AS obs_count FROM {{pixels}} p CROSS JOIN (VALUES (1996, 3), (1996, 4), (2001, 12)) AS t(year, month)
 LEFT JOIN c ON c.pixel_id = p.pixel_id AND c.year = t.year AND c.month = t.month""")
def composite_empty_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """December 2001 has no scenes: every pixel is there, without value."""
    return composite.monthly_dense(stand_in(spark, sf_dir), view(spark, sf_dir, "pixels"), [(1996, 3), (1996, 4), (2001, 12)])


@query("""SELECT strftime(make_date(y, m, 1), '%Y%m') AS system_index, 'IA' AS state, y AS year, m AS month, CAST(epoch_ms(CAST(make_date(y, m, 1) AS TIMESTAMP)) AS BIGINT) AS start,
 CAST(epoch_ms(make_date(y, m, 1) + INTERVAL 1 MONTH) AS BIGINT) AS "end", 0.01e0 AS "LAI_scale_factor", 'median' AS composite_reducer, FALSE AS nonveg, 50e0 AS cloud_limit, '0.2.0' AS "LAI_version", n AS retrievals
 FROM (SELECT CAST(year(time_start) AS INT) AS y, CAST(month(time_start) AS INT) AS m, count(*) AS n FROM {lai_qa} WHERE (qa & 3) = 0 AND biome > 0 GROUP BY ALL)""")
def composite_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = composite.monthly(stand_in(spark, sf_dir)).groupBy("year", "month").agg(F.sum("obs_count").alias("retrievals"))
    return months.select(*[c.alias(n) for n, c in composite.properties(F.col("year"), F.col("month"), F.lit("IA")).items()], "retrievals")


# Density


@query("""SELECT p.pixel_id, CAST(y.year AS INT) AS year, m.month, count(c.pixel_id) AS obs_count FROM {pixels} p CROSS JOIN range(1995, 2001) AS y(year) CROSS JOIN {months} m
 LEFT JOIN {clear} c ON c.pixel_id = p.pixel_id AND c.year = y.year AND c.month = m.month GROUP BY ALL""")
def clear_obs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.clear_obs_count(clear_rows(spark, sf_dir), view(spark, sf_dir, "pixels"), YEARS)


@query("SELECT pixel_id, month, round(obs_count, 6) AS obs_count FROM {mean_counts}")
def mean_obs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_counts(spark, sf_dir).select("pixel_id", "month", six("obs_count"))


_LABEL = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month]"
_STATS = "round(avg(obs_count), 6) AS obs_count_mean, round(median(obs_count), 6) AS obs_count_median"
_TAILS = ", ".join(f"round(quantile_cont(obs_count, {p / 100}), 6) AS obs_count_p{p}" for p in density.PERCENTILES)


@query(f"SELECT month AS month_num, {_LABEL} AS month_label, {_STATS}, {_TAILS} FROM {{mean_counts}} GROUP BY month")
def monthly_obs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.monthly_obs_stats(mean_counts(spark, sf_dir))
    return found.select("month_num", "month_label", *[six(c) for c in found.columns[2:]])


@query(f"SELECT month AS month_num, {_LABEL} AS month_label, {_STATS}, {_TAILS} FROM {{mean_counts}} WHERE grid_row % 2 = 1 AND grid_col % 2 = 1 GROUP BY month")
def coarse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.monthly_obs_stats(grid.coarse_sample(mean_counts(spark, sf_dir), 2))
    return found.select("month_num", "month_label", *[six(c) for c in found.columns[2:]])


@query("SELECT month AS month_num, p AS percentile, count(*) AS pixels, TRUE AS within FROM {mean_counts} CROSS JOIN (VALUES (10), (25), (50), (75), (90)) AS t(p) GROUP BY ALL")
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each month from sketches of zones, merged; `within` tells whether the rank is within a hundredth of the one asked for, by counting all values."""
    counts, percentiles = mean_counts(spark, sf_dir), [10, 25, 50, 75, 90]
    merged = sketches.merge(sketches.sketch(counts, "obs_count", ["state_key", "month"]), ["month"])
    found = sketches.quantiles(merged, "obs_count", percentiles)
    asked = found.select("month", F.inline(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"obs_count_p{p}").alias("quantile")) for p in percentiles])))
    ranks = counts.select("month", "obs_count").join(asked, "month").groupBy("month", "percentile")
    below, upto = F.avg((F.col("obs_count") < F.col("quantile")).cast("double")), F.avg((F.col("obs_count") <= F.col("quantile")).cast("double"))
    share = F.col("percentile") / 100
    return ranks.agg(F.count(F.lit(1)).alias("pixels"), ((below - 0.01 <= share) & (share <= upto + 0.01)).alias("within")).withColumnRenamed("month", "month_num")


@query(f"SELECT region, month AS month_num, {_LABEL} AS month_label, {_STATS} FROM {{mean_counts}} c JOIN {{region_states}} r ON c.state_key = r.state_key GROUP BY region, month")
def regional_obs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.regional_obs_stats(mean_counts(spark, sf_dir), view(spark, sf_dir, "region_states"), "state_key")
    return found.select("region", "month_num", "month_label", six("obs_count_mean"), six("obs_count_median"))


@query(f"""SELECT region, CAST(1997 AS INT) AS year, month, {_STATS} FROM (SELECT p.pixel_id, p.state_key, m.month, count(c.pixel_id) AS obs_count FROM {{pixels}} p CROSS JOIN {{months}} m
 LEFT JOIN {{clear}} c ON c.pixel_id = p.pixel_id AND c.year = 1997 AND c.month = m.month GROUP BY ALL) x JOIN {{region_states}} r ON x.state_key = r.state_key WHERE month IN (1, 7) GROUP BY region, month""")
def regional_single_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "pixels").select("pixel_id", "state_key")
    one = DensityParams(1997, 1997)
    clear = density.clear_rows(view(spark, sf_dir, "obs"), view(spark, sf_dir, "scenes"), one)
    counts = density.clear_obs_count(clear, pixels, one).join(pixels, "pixel_id")
    found = density.regional_single_year(counts, view(spark, sf_dir, "region_states"), 1997, [1, 7], "state_key")
    return found.select("region", "year", "month", six("obs_count_mean"), six("obs_count_median"))


@query(f"""SELECT month AS month_num, {_LABEL} AS month_label, round(avg(CASE WHEN obs_count < 1 THEN 1e0 ELSE 0e0 END), 6) AS gap, round(avg(CASE WHEN obs_count < 2 THEN 1e0 ELSE 0e0 END), 6) AS gap_lt2
 FROM {{mean_counts}} WHERE is_veg = 1 GROUP BY month""")
def gap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.gap_fraction(mean_counts(spark, sf_dir), mask=F.col("is_veg") == 1)
    return found.select("month_num", "month_label", six("gap"), six("gap_lt2"))


@query(f"SELECT month AS month_num, {_LABEL} AS month_label, round(avg(CASE WHEN obs_count < 1 THEN 1e0 ELSE 0e0 END), 6) AS obs_count FROM {{mean_counts}} GROUP BY month")
def gap_fraction_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.gap_fraction(mean_counts(spark, sf_dir), {"obs_count": 1.0})
    return found.select("month_num", "month_label", six("obs_count"))


# Files, mosaics, grids

_PATHS = "concat('LAI/', n_name, CASE n_nationkey % 3 WHEN 0 THEN '.tiff' WHEN 1 THEN '.tif' ELSE '.txt' END)"


@query(f"""SELECT path, CASE WHEN ends_with(path, '.tif') THEN 0 ELSE 1 END AS ext_rank, CAST(row_number() OVER (ORDER BY CASE WHEN ends_with(path, '.tif') THEN 0 ELSE 1 END, string_split(path, '/')) - 1 AS INT) AS tile_ordinal
 FROM (SELECT {_PATHS} AS path FROM nation) WHERE NOT ends_with(path, '.txt')""")
def tile_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.in_merge_order(view(spark, sf_dir, "nation").select(F.expr(_PATHS).alias("path")))


@query("""SELECT n_nationkey, concat('LAI_', n_name, '_', '2021', '_', lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0')) AS lai_name,
 concat('obscount_CONUS_', lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0')) AS density_name FROM nation""")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.col("n_nationkey") % 12 + 1
    return view(spark, sf_dir, "nation").select("n_nationkey", composite.export_name(F.col("n_name"), F.lit(2021), month).alias("lai_name"), composite.density_name(month).alias("density_name"))


@query("SELECT grid_row, grid_col, round(value, 6) AS value, tile_ordinal FROM {mosaic}")
def mosaic_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(nodata=0))
    return found.select("grid_row", "grid_col", six("value"), "tile_ordinal")


@query("SELECT grid_row, grid_col, round(arg_min(raw, tile_ordinal) * 0.01e0, 6) AS value, min(tile_ordinal) AS tile_ordinal FROM {ordered_tiles} WHERE raw <> 0 GROUP BY ALL")
def mosaic_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(prefer="dest", nodata=0))
    return found.select("grid_row", "grid_col", six("value"), "tile_ordinal")


@query("""SELECT p.grid_row, p.grid_col, m.value, m.tile_ordinal FROM {pixels} p LEFT JOIN (SELECT grid_row, grid_col, arg_max(raw, tile_ordinal) AS value, max(tile_ordinal) AS tile_ordinal
 FROM {ordered_tiles} WHERE raw BETWEEN 50 AND 700 GROUP BY ALL) m ON p.grid_row = m.grid_row AND p.grid_col = m.grid_col""")
def mosaic_valid_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own validity, no scaling, on the dense grid."""
    found = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(scale=None), valid=lambda raw: raw.between(50, 700))
    return mosaic.on_grid(found, view(spark, sf_dir, "pixels"))


@query("""SELECT t.r AS grid_row, t.c AS grid_col, round(m.value, 6) AS value FROM (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(floor((300 - (310 - (r + 0.5) * 45)) / 30) AS INT) AS sr, CAST(floor((15 + (c + 0.5) * 45) / 30) AS INT) AS sc
 FROM range(0, 7) AS a(r), range(0, 14) AS b(c)) t JOIN {mosaic} m ON m.grid_row = t.sr AND m.grid_col = t.sc""")
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(nodata=0)).drop("tile_ordinal")
    return grid.warp_nearest(source, GRID, grid.cells(spark, COARSE), COARSE).select("grid_row", "grid_col", six("value"))


def _block_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The first and the later tiles, each half merged, as tables of blocks of 8 x 8 cells."""
    placed, found = ordered_tiles(spark, sf_dir), []
    for half in (F.col("tile_ordinal") < 12, F.col("tile_ordinal") >= 12):
        cells = mosaic.merge(placed.where(half), MosaicParams(nodata=0, scale=None))
        name = f"blocks_{uuid.uuid4().hex}"
        found.append(raster_blocks.save(raster_blocks.to_blocks(cells, GRID, size=8), f"{shared_folder(spark)}/{name}", name, 8))
        raster_blocks.forget(spark, name)
    return found


@query("SELECT grid_row, grid_col, round(value, 6) AS value FROM {mosaic}")
def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of clipped blocks merged where they lie, the later tiles on top."""
    merged = raster_blocks.merge(*_block_tables(spark, sf_dir))
    return raster_blocks.to_cells(merged, 8).select("grid_row", "grid_col", six(F.col("value") * 0.01, "value"))


@query("""SELECT CAST(floor(grid_row / 4) AS INT) AS grid_row, CAST(floor(grid_col / 4) AS INT) AS grid_col, round(CAST(sum(raw) AS DOUBLE) / count(*), 6) AS value
 FROM (SELECT grid_row, grid_col, arg_max(raw, tile_ordinal) AS raw FROM {ordered_tiles} WHERE raw <> 0 GROUP BY ALL) GROUP BY ALL""")
def block_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview of merged blocks, each block by itself."""
    return raster_blocks.overview(raster_blocks.merge(*_block_tables(spark, sf_dir)), 4, 8).select("grid_row", "grid_col", six("value"))


@query("""SELECT CAST(floor(grid_row / 8) AS INT) AS block_row, CAST(floor(grid_col / 8) AS INT) AS block_col, CAST(count(*) AS INT) AS count, CAST(sum(raw) AS DOUBLE) AS total, CAST(min(raw) AS DOUBLE) AS least, CAST(max(raw) AS DOUBLE) AS largest
 FROM (SELECT grid_row, grid_col, arg_max(raw, tile_ordinal) AS raw FROM {ordered_tiles} WHERE raw <> 0 GROUP BY ALL) GROUP BY ALL""")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_blocks.statistics(raster_blocks.merge(*_block_tables(spark, sf_dir)))


@query("SELECT grid_row, grid_col, round(value, 6) AS value, tile_ordinal FROM {mosaic}")
def mosaic_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles added in three batches, late ones before early ones: the same mosaic as in one go."""
    path = f"{shared_folder(spark)}/mosaic-{uuid.uuid4().hex}"
    placed, params = ordered_tiles(spark, sf_dir), MosaicParams(nodata=0)
    for batch in (1, 2, 0):
        increments.add_tiles(placed.where(F.col("tile_ordinal") % 3 == batch), path, params, 8)
    return increments.current(spark, path, params).select("grid_row", "grid_col", six("value"), "tile_ordinal")


#: The tiles' own grid in degrees, and an Albers grid that covers part of it and some ground beside it.
DEGREES = grid.GridSpec(x0=-98.0, y0=40.0, dx=0.004, dy=0.003, width=20, height=10, nodata=-9999.0, crs="EPSG:4269")
ALBERS = grid.GridSpec(x0=-170500.0, y0=1887500.0, dx=270.0, dy=290.0, width=26, height=15)


def _back(points: str) -> str:
    """Oracle: `points` (r, c: rows and columns of the ALBERS grid, any others) with v and u, their place on the DEGREES grid: Albers undone by six steps of Snyder's iteration."""
    found = f"""SELECT *, sqrt(x * x + (r0 - y) * (r0 - y)) AS rho, degrees(radians(-96e0) + atan2(x, r0 - y) / n) AS lon FROM (SELECT *, -170500e0 + c * 270e0 AS x, 1887500e0 - r * 290e0 AS y FROM ({points}))
 CROSS JOIN (SELECT 0.60290276906576e0 AS n, 1.3491820315609704e0 AS k, 9928937.004248783e0 AS r0, 6378137e0 AS a, (1 / 298.257222101e0) * (2 - 1 / 298.257222101e0) AS e2, sqrt((1 / 298.257222101e0) * (2 - 1 / 298.257222101e0)) AS e)"""
    found = f"SELECT *, (k - rho * rho * n * n / (a * a)) / n AS q FROM ({found})"
    found = f"SELECT *, asin(q / 2) AS lat FROM ({found})"
    for _ in range(6):
        step = "lat + power(1 - e2 * sin(lat) * sin(lat), 2) / (2 * cos(lat)) * (q / (1 - e2) - sin(lat) / (1 - e2 * sin(lat) * sin(lat)) + ln((1 - e * sin(lat)) / (1 + e * sin(lat))) / (2 * e))"
        found = f"SELECT * REPLACE ({step} AS lat) FROM ({found})"
    return f"SELECT * EXCLUDE (x, y, rho, lon, n, k, r0, a, e2, e, q, lat), (40e0 - degrees(lat)) / 0.003e0 AS v, (lon + 98e0) / 0.004e0 AS u FROM ({found})"


_CELLS = "SELECT CAST(i AS INT) AS grid_row, CAST(j AS INT) AS grid_col, {} FROM range(0, 15) AS a(i), range(0, 26) AS b(j)"
_CENTRES = f"({_back(_CELLS.format('i + 0.5e0 AS r, j + 0.5e0 AS c'))}) WHERE v >= 0 AND u >= 0 AND v < 10 AND u < 20"
_FOUR = f"SELECT grid_row, grid_col, floor(v - 0.5) + di AS sr, floor(u - 0.5) + dj AS sc, abs(1 - di - (v - 0.5 - floor(v - 0.5))) * abs(1 - dj - (u - 0.5 - floor(u - 0.5))) AS w FROM {_CENTRES.replace(' WHERE', ' CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(di, dj) WHERE')}"
_BOXES = f"SELECT grid_row, grid_col, min(v) AS v0, max(v) AS v1, min(u) AS u0, max(u) AS u1 FROM ({_back(_CELLS.format('i + di AS r, j + dj AS c') + ', (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(di, dj)')}) GROUP BY ALL"
_AREAS = f"SELECT grid_row, grid_col, sr, sc, (least(v1, sr + 1) - greatest(v0, sr)) * (least(u1, sc + 1) - greatest(u0, sc)) AS w FROM ({_BOXES}), range(0, 10) AS d(sr), range(0, 20) AS e(sc) WHERE sr < v1 AND sr + 1 > v0 AND sc < u1 AND sc + 1 > u0"
_NEAREST = f"SELECT grid_row, grid_col, floor(v) AS sr, floor(u) AS sc, 1e0 AS w FROM {_CENTRES}"


def _warped(touches: str) -> str:
    """Oracle: each tile by its weights, then the last tile of each cell."""
    return f"""SELECT grid_row, grid_col, round(arg_max(raw, tile_ordinal) * 0.01e0, 6) AS value, max(tile_ordinal) AS tile_ordinal FROM (SELECT t.grid_row, t.grid_col, s.tile_ordinal, sum(w * s.raw) / sum(w) AS raw
 FROM ({touches}) t JOIN {{ordered_tiles}} s ON s.grid_row = t.sr AND s.grid_col = t.sc WHERE s.raw <> 0 AND w > 1e-9 GROUP BY ALL) GROUP BY ALL"""


def _warp_tiles(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    found = warp.warp_mosaic(ordered_tiles(spark, sf_dir), DEGREES, ALBERS, MosaicParams(nodata=0, resampling=method))
    return found.select("grid_row", "grid_col", six("value"), "tile_ordinal")


@query(_warped(_NEAREST))
def warp_degrees_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in degrees brought onto an Albers grid, the last one winning."""
    return _warp_tiles(spark, sf_dir, "nearest")


@query(_warped(_FOUR))
def warp_degrees_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warp_tiles(spark, sf_dir, "bilinear")


@query(_warped(_AREAS))
def warp_degrees_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warp_tiles(spark, sf_dir, "average")


_COARSE = "SELECT CAST(i AS INT) AS grid_row, CAST(j AS INT) AS grid_col, {} FROM range(0, 7) AS a(i), range(0, 14) AS b(j)"
_SAME = """SELECT t.grid_row, t.grid_col, round(sum(w * m.value) / sum(w), 6) AS value FROM ({}) t JOIN {{mosaic}} m ON m.grid_row = t.sr AND m.grid_col = t.sc WHERE w > 1e-9 GROUP BY ALL"""


@query(_SAME.format(f"""SELECT grid_row, grid_col, floor(v) + di AS sr, floor(u) + dj AS sc, abs(1 - di - (v - floor(v))) * abs(1 - dj - (u - floor(u))) AS w
 FROM ({_COARSE.format("((i + 0.5) * 45 - 10) / 30e0 - 0.5 AS v, ((j + 0.5) * 45 + 15) / 30e0 - 0.5 AS u")}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(di, dj) WHERE v >= -0.5 AND u >= -0.5 AND v < 9.5 AND u < 19.5"""))
def warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within one coordinate system: the mosaic on a shifted grid of larger cells."""
    source = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(nodata=0)).drop("tile_ordinal")
    return warp.warp(source, GRID, COARSE, "bilinear").select("grid_row", "grid_col", six("value"))


@query(_SAME.format(f"""SELECT grid_row, grid_col, sr, sc, (least(v + 1.5, sr + 1) - greatest(v, sr)) * (least(u + 1.5, sc + 1) - greatest(u, sc)) AS w
 FROM ({_COARSE.format("(i * 45 - 10) / 30e0 AS v, (j * 45 + 15) / 30e0 AS u")}), range(0, 10) AS d(sr), range(0, 20) AS e(sc) WHERE sr < v + 1.5 AND sr + 1 > v AND sc < u + 1.5 AND sc + 1 > u"""))
def warp_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(nodata=0)).drop("tile_ordinal")
    return warp.warp(source, GRID, COARSE, "average").select("grid_row", "grid_col", six("value"))


@query("""WITH last AS (SELECT grid_row, grid_col, arg_max(raw, tile_ordinal) AS raw FROM {ordered_tiles} WHERE raw <> 0 GROUP BY ALL)
 SELECT CAST(f AS INT) AS level, CAST(floor(grid_row / f) AS INT) AS grid_row, CAST(floor(grid_col / f) AS INT) AS grid_col, round(CAST(sum(raw) AS DOUBLE) / count(*) * 0.01e0, 6) AS value
 FROM last CROSS JOIN (VALUES (2), (4), (8), (16), (32)) AS t(f) GROUP BY ALL""")
def overview_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of whole raw values, scaled once: sums of scaled doubles would depend on their order."""
    source = mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(nodata=0, scale=None))
    return grid.overview_pyramid(source, [2, 4, 8, 16, 32], scale=0.01).select("level", "grid_row", "grid_col", six("value"))


@query("SELECT p.grid_row, p.grid_col, round(CAST(CAST(m.value AS FLOAT) AS DOUBLE), 4) AS value FROM {pixels} p LEFT JOIN {mosaic} m ON p.grid_row = m.grid_row AND p.grid_col = m.grid_col")
def geotiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic written as GeoTIFF files and read again: masked cells come back masked."""
    dense = mosaic.on_grid(mosaic.merge(ordered_tiles(spark, sf_dir), MosaicParams(nodata=0)), view(spark, sf_dir, "pixels"))
    path = f"{shared_folder(spark)}/geotiff-{uuid.uuid4().hex}"
    files = geotiff.encode(dense, GRID, geotiff.TiffOptions(block=16, tile=64))
    geotiff.write(files, path)
    return geotiff.read_cells(spark, path).select("grid_row", "grid_col", F.round(F.col("value").cast("double"), 4).alias("value"))
