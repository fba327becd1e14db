"""Tables kept in folders by their search keys: scene catalogs by sensor, year and month, training samples by sensor and biome.

A filter on the keys reads only their folders. A join with a small table of wanted keys does so too: Spark reads that table first and prunes the folders at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastack.schemas import FEATURES, LABEL
from terrastack.sources.catalog import sensor_code

CATALOG_KEYS = ["sensor", "year", "month"]
SAMPLE_KEYS = ["sensor", "biome2"]
#: What a training sample has; other columns are left out.
SAMPLES = T.StructType([T.StructField("sensor", T.StringType()), T.StructField("biome2", T.IntegerType()), *[T.StructField(f, T.DoubleType()) for f in [*FEATURES, LABEL]]])


def write_by_keys(table: DataFrame, path: str, keys: list[str], mode: str = "errorifexists", most_rows: int = 0) -> None:
    """A folder for each key. Rows of a key are brought together first, large keys being split by size, so that a folder has few files; of `most_rows` rows at most, unless that is 0."""
    table.hint("rebalance", *keys).write.mode(mode).option("maxRecordsPerFile", most_rows).partitionBy(*keys).parquet(path)


def write_catalog(scenes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scenes (spacecraft_id, time_start, ...) by sensor, year and month; scenes of other spacecraft or without time are kept in folders of their own."""
    dated = scenes.withColumns({"sensor": sensor_code(F.col("spacecraft_id")), "year": F.year("time_start"), "month": F.month("time_start")})
    write_by_keys(dated, path, CATALOG_KEYS, mode)


def scenes_of(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scenes of the keys in `wanted` (sensor, year, month); repeated and null keys ask once and for nothing."""
    keys = wanted.select(*CATALOG_KEYS).dropna().distinct()
    return catalog.join(keys, CATALOG_KEYS)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Training samples by sensor and biome, so that each forest reads its own rows only."""
    write_by_keys(checked_samples(samples), path, SAMPLE_KEYS, mode)


def checked_samples(samples: DataFrame) -> DataFrame:
    """The columns of SAMPLES, numbers widened; an error names columns that are absent or of another kind."""
    kinds = dict(samples.dtypes)
    wrong = [f.name for f in SAMPLES if f.name not in kinds]
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wrong += [f.name for f in SAMPLES if f.name in kinds and not (kinds[f.name] in numbers or kinds[f.name].startswith("decimal") if f.dataType != T.StringType() else kinds[f.name] == "string")]
    if wrong:
        raise ValueError(f"training samples need {', '.join(wrong)} as {', '.join(SAMPLES[w].dataType.simpleString() for w in wrong)}")
    return samples.select(*[F.col(f.name).cast(f.dataType) for f in SAMPLES])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """SAMPLES from Parquet, in folders by key or not."""
    return checked_samples(spark.read.parquet(path))
