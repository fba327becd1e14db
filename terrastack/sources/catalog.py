"""Scene catalogs: union of sensors, time, cloud and zone filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.schemas import SENSOR_OF_DIGIT


def read_scenes(spark: SparkSession, *paths: str) -> DataFrame:
    """One catalog of all `paths`, duplicates kept, columns matched by name (absent ones are null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def spacecraft_number(spacecraft: Column) -> Column:
    """The ninth character of the spacecraft's name as a number; null if it is none."""
    return F.substring(spacecraft, 9, 1).try_cast("int")


def sensor_code(spacecraft: Column) -> Column:
    """LT05, LE07 or LC08; null for other spacecraft."""
    number = spacecraft_number(spacecraft)
    return F.coalesce(*[F.when(number == d, F.lit(s)) for d, s in SENSOR_OF_DIGIT.items()])


def filter_dates(scenes: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Scenes from `start` on, before `end`."""
    start, end = (F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x for x in (start, end))
    return scenes.where((F.col("time_start") >= start) & (F.col("time_start") < end))


def filter_cloud(scenes: DataFrame, limit: float | None = None) -> DataFrame:
    """Scenes with a cloud cover strictly below `limit` (50 if not given)."""
    return scenes.where(F.col("cloud_cover") < F.lit(50.0 if limit is None else float(limit)))


def filter_bounds(scenes: DataFrame, footprints: DataFrame) -> DataFrame:
    """Scenes that have at least one row in `footprints` (scene_id): those that meet the region."""
    return scenes.join(footprints.select("scene_id"), "scene_id", "left_semi")


def check_spacecraft(scenes: DataFrame) -> DataFrame:
    """`scenes` as they are; reading a row of an unknown spacecraft raises an error."""
    known = sensor_code(F.col("spacecraft_id"))
    return scenes.withColumn("sensor", F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown spacecraft: "), F.coalesce("spacecraft_id", F.lit("null")))).cast("string")))


def catalog(scenes: DataFrame, start: str, end: str, cloud_limit: float | None = None) -> DataFrame:
    """Filtered scenes with their sensor code and spacecraft number."""
    kept = filter_cloud(filter_dates(scenes, start, end), cloud_limit)
    return kept.withColumn("sensor", sensor_code(F.col("spacecraft_id"))).withColumn("spacecraft_no", spacecraft_number(F.col("spacecraft_id")))
