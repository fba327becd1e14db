"""Table schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCENES = T.StructType(
    [
        T.StructField("scene_id", T.LongType()),
        T.StructField("spacecraft_id", T.StringType()),
        T.StructField("time_start", T.TimestampNTZType()),
        T.StructField("cloud_cover", T.DoubleType()),
        T.StructField("sun_elevation", T.DoubleType()),
        T.StructField("sun_azimuth", T.DoubleType()),
        T.StructField("solar_zenith_angle", T.DoubleType()),
        T.StructField("solar_azimuth_angle", T.DoubleType()),
    ]
)
OBSERVATIONS = T.StructType([T.StructField("scene_id", T.LongType()), T.StructField("pixel_id", T.LongType()), *[T.StructField(f"sr_b{i}", T.IntegerType()) for i in range(1, 8)], T.StructField("qa_pixel", T.IntegerType())])
ZONES = T.StructType([T.StructField("pixel_id", T.LongType()), T.StructField("state", T.StringType())])
LAND_COVER = T.StructType([T.StructField("pixel_id", T.LongType()), T.StructField("epoch", T.IntegerType()), T.StructField("release_rank", T.IntegerType()), T.StructField("landcover", T.IntegerType())])
HULL = T.StructType([T.StructField("sensor", T.StringType()), T.StructField("hull_index", T.IntegerType()), T.StructField("in_hull", T.IntegerType())])

# What results depend on.
EXCLUDED_ZONES = ["AK", "HI", "PR", "VI", "GU", "MP", "AS"]
SENSOR_OF_DIGIT = {5: "LT05", 7: "LE07", 8: "LC08", 9: "LC08"}
BANDS_8_9 = {"blue": "sr_b2", "green": "sr_b3", "red": "sr_b4", "nir": "sr_b5", "swir1": "sr_b6", "swir2": "sr_b7"}
BANDS_5_7 = {"blue": "sr_b1", "green": "sr_b2", "red": "sr_b3", "nir": "sr_b4", "swir1": "sr_b5", "swir2": "sr_b7"}
#: (first year, last year, land-cover epoch)
EPOCH_YEARS = [(1984, 2002, 2001), (2003, 2005, 2004), (2006, 2007, 2006), (2008, 2009, 2008), (2010, 2012, 2011), (2013, 2014, 2013), (2015, 2017, 2016), (2018, 2020, 2019), (2021, 2024, 2021)]
BIOME_OF_CLASS = {11: 0, 12: 0, 21: 0, 22: 0, 23: 0, 24: 0, 31: 0, 41: 1, 42: 2, 43: 3, 51: 0, 52: 4, 71: 5, 72: 0, 73: 0, 74: 0, 81: 5, 82: 6, 90: 7, 95: 8}
REFLECTANCE_LIMIT = {"red": 5100.0, "green": 5100.0, "nir": 7100.0, "swir1": 7100.0}
LAI_LIMIT = 8.0
QA_CLOUD, QA_SHADOW, QA_WATER = 1 << 3, 1 << 4, 1 << 7
FLAG_HULL, FLAG_RANGE, FLAG_NONVEG = 1, 2, 4
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FEATURES = ["red", "green", "nir", "swir1", "lat", "lon", "NDVI", "NDWI", "sun_zenith", "sun_azimuth"]
LABEL = "MCD_LAI"
#: Region name to member states; None stands for all.
REGIONS_ANALYSIS = {"PNW": ["WA", "OR"], "SE": ["FL", "GA", "AL", "MS", "SC"], "MW": ["IA", "IL", "IN", "OH", "MO"], "SW": ["AZ", "NM", "NV", "UT"]}
REGIONS_EXPORT = {
    "CONUS": None,
    "PacificNW": ["WA", "OR"],
    "Southeast": ["FL", "GA", "AL", "MS", "SC", "NC"],
    "Midwest": ["IA", "IL", "IN", "OH", "MO", "MN", "WI", "MI"],
    "Southwest": ["AZ", "NM", "NV", "UT", "CA"],
    "Northeast": ["NY", "PA", "NJ", "CT", "MA", "VT", "NH", "ME", "RI"],
    "GreatPlains": ["KS", "NE", "SD", "ND", "OK", "TX"],
}


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of literals. It stays part of the plan, with its size known, so joins with it are broadcast."""
    texts = ("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {', '.join(texts)} AS t({columns})")


def epoch_by_year(spark: SparkSession) -> DataFrame:
    """year, epoch: the land-cover epoch that stands for each year."""
    return literal_table(spark, "year, epoch", [(y, e) for first, last, e in EPOCH_YEARS for y in range(first, last + 1)])


def class_map(spark: SparkSession) -> DataFrame:
    """landcover, biome, is_veg for each known class."""
    return literal_table(spark, "landcover, biome, is_veg", [(c, b, int(b > 0)) for c, b in BIOME_OF_CLASS.items()])


def region_states(spark: SparkSession, regions: dict[str, list[str] | None], states: list[str]) -> DataFrame:
    """region, state: membership; regions may overlap and need not cover every state."""
    return literal_table(spark, "region, state", [(r, s) for r, members in regions.items() for s in (states if members is None else members)])
