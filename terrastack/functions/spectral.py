"""Bands, reflectance, indices and solar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.schemas import BANDS_5_7, BANDS_8_9
from terrastack.sources.catalog import spacecraft_number

#: Fixed values of the surface-reflectance product: (dn * GAIN + OFFSET) / UNIT.
GAIN, OFFSET, UNIT = 2.75e-5, -0.2, 1e-4
BANDS = ["green", "red", "nir", "swir1"]


def rename_bands(obs: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """`obs` (sr_b1 to sr_b7, spacecraft_id) with colour names instead of band numbers, whatever the sensor."""
    newer = spacecraft_number(F.col("spacecraft_id")) >= 8
    wanted = bands or list(BANDS_8_9)
    colours = {b: F.when(newer, F.col(BANDS_8_9[b])).otherwise(F.col(BANDS_5_7[b])) for b in wanted}
    return obs.withColumns(colours).drop(*[f"sr_b{i}" for i in range(1, 8)])


def reflectance(dn: Column) -> Column:
    return (dn * F.lit(GAIN) + F.lit(OFFSET)) / F.lit(UNIT)


def scale_bands(obs: DataFrame, prefix: str = "", bands: list[str] = BANDS) -> DataFrame:
    """Digital numbers <prefix><band> as scaled reflectances <band>."""
    return obs.withColumns({b: reflectance(F.col(f"{prefix}{b}")) for b in bands})


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); masked where the sum is 0 or a band is masked."""
    return F.try_divide(a - b, a + b)


def add_indices(obs: DataFrame) -> DataFrame:
    return obs.withColumns({"NDVI": normalized_difference(F.col("nir"), F.col("red")), "NDWI": normalized_difference(F.col("nir"), F.col("swir1"))})


def _optional(frame: DataFrame, name: str) -> Column:
    return F.col(name) if name in frame.columns else F.lit(None).cast("double")


def solar_geometry(scenes: DataFrame) -> DataFrame:
    """Adds sun_zenith and sun_azimuth: from elevation and azimuth, else the older names' angles, else 45 and 180 degrees."""
    return scenes.withColumns(
        {
            "sun_zenith": F.coalesce(F.lit(90.0) - _optional(scenes, "sun_elevation"), _optional(scenes, "solar_zenith_angle"), F.lit(45.0)),
            "sun_azimuth": F.coalesce(_optional(scenes, "sun_azimuth"), _optional(scenes, "solar_azimuth_angle"), F.lit(180.0)),
        }
    )
