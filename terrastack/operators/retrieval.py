"""Feature tables and random-forest retrieval, one model for each key."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.functions.masks import clear_sky, where_valid
from terrastack.functions.spectral import add_indices, scale_bands, solar_geometry
from terrastack.params import ForestParams
from terrastack.schemas import FEATURES, LABEL
from terrastack.sources.partitioned import write_by_keys
from terrastack.sources.shared import shared_folder

#: Rows of a file of rows kept by key.
FILE_ROWS = 200_000
#: Rows of a task in training, until there are TASKS_A_CORE tasks for each core: each task keeps sums for the nodes of all trees.
TASK_ROWS, TASKS_A_CORE = 25_000, 16
#: A forest of more rows is fitted alone. Spark's forest keeps some 650 bytes of each row.
ALONE_ROWS = 4_000_000


def clear_observations(obs: DataFrame, scenes: DataFrame, prefix: str = "dn_") -> DataFrame:
    """Cloud-free observations of `scenes` with reflectances, indices and solar angles.

    Both sides are filtered before the join; which side is broadcast, if any, is left to the optimizer.
    """
    lit = solar_geometry(scenes)
    joined = obs.where(clear_sky(F.col("qa_pixel"))).join(lit, "scene_id")
    return add_indices(scale_bands(joined, prefix)).drop(*[c for c in obs.columns if prefix and c.startswith(prefix)])


def feature_table(clear: DataFrame, pixels: DataFrame) -> DataFrame:
    """Clear observations with the pixel's lon, lat and biome: the ten features and the key of the model."""
    return clear.join(pixels, "pixel_id")


def train(samples: DataFrame, key: tuple[str, int] | None = None, params: ForestParams = ForestParams(), features: list[str] = FEATURES, label: str = LABEL) -> RandomForestRegressionModel:
    """A forest on the samples of one (sensor, biome). Biome 0, or pool_biomes, takes all biomes of the sensor; masked rows are left out."""
    if key is not None:
        sensor, biome = key
        samples = samples.where(F.col("sensor") == sensor)
        if biome > 0 and not params.pool_biomes:
            samples = samples.where(F.col("biome2") == biome)
    rows = VectorAssembler(inputCols=features, outputCol="features_", handleInvalid="skip").transform(samples.dropna(subset=[label]))
    forest = RandomForestRegressor(featuresCol="features_", labelCol=label, predictionCol="prediction_", numTrees=params.trees, minInstancesPerNode=params.min_leaf, featureSubsetStrategy=str(min(params.split_features, len(features))), seed=params.seed)
    return forest.fit(rows)


def keep_by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows`, worked out once and written by `keys` to the shared folder, in files of bounded length, so that a large key is read by many tasks."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    write_by_keys(rows, path, keys, most_rows=FILE_ROWS)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def train_all(samples: DataFrame, keys: list[tuple[str, int]], params: ForestParams = ForestParams(), features: list[str] = FEATURES, at_once: int = 4) -> dict[tuple[str, int], RandomForestRegressionModel]:
    """A forest for each (sensor, biome), `at_once` of them at a time.

    `samples` are written by key to the shared folder first, and each forest reads its own folders only: all samples are worked out once, not once a forest.
    """
    kept = keep_by_key(samples.select("sensor", "biome2", *features, LABEL), ["sensor", "biome2"])
    return train_kept(kept, keys, params, features, at_once)


def train_kept(kept: DataFrame, keys: list[tuple[str, int]], params: ForestParams = ForestParams(), features: list[str] = FEATURES, at_once: int = 4) -> dict[tuple[str, int], RandomForestRegressionModel]:
    """train_all on samples that lie in folders by key already.

    A forest's rows are dealt evenly to as many tasks as they need, however few files they come from. Forests are fitted from the largest down; those of more
    than ALONE_ROWS rows one at a time, since each keeps its rows in memory while it is fitted.
    """
    sizes = {(r.sensor, r.biome2): r["count"] for r in kept.groupBy("sensor", "biome2").count().collect()}
    most = TASKS_A_CORE * kept.sparkSession.sparkContext.defaultParallelism

    many = {key: sum(n for k, n in sizes.items() if k == key or k[0] == key[0] and (key[1] == 0 or params.pool_biomes)) for key in keys}

    def fit(key: tuple[str, int]) -> RandomForestRegressionModel:
        own = kept.select("sensor", "biome2", *features, LABEL).where(F.col("sensor") == key[0])
        if key[1] > 0 and not params.pool_biomes:
            own = own.where(F.col("biome2") == key[1])
        return train(own.repartition(max(1, min(most, -(-many[key] // TASK_ROWS)))), key, params, features)

    order = sorted(keys, key=many.get, reverse=True)
    models = {key: fit(key) for key in order if many[key] > ALONE_ROWS}
    rest = [key for key in order if key not in models]
    with ThreadPoolExecutor(at_once) as pool:
        models |= zip(rest, pool.map(fit, rest), strict=True)
    return {key: models[key] for key in keys}


def predict(model: RandomForestRegressionModel, obs: DataFrame, out: str = "lai_real", features: list[str] = FEATURES) -> DataFrame:
    """`obs` with the model's value; masked where a feature is masked."""
    whole = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in features))
    filled = VectorAssembler(inputCols=[f"f{i}_" for i in range(len(features))], outputCol="features_").transform(obs.withColumns({f"f{i}_": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)}))
    found = model.transform(filled).withColumn(out, F.when(whole, F.col("prediction_")))
    return found.drop("features_", "prediction_", *[f"f{i}_" for i in range(len(features))])


def retrieve(obs: DataFrame, models: dict[tuple[str, int], RandomForestRegressionModel], nonveg: bool = False, features: list[str] = FEATURES) -> DataFrame:
    """lai_real of each observation by the model of its (sensor, biome): biomes 1 to 8, and 0 as well if `nonveg`.

    Observations are worked out once, written by key to the shared folder, and each key's files meet one model: at most 27 disjoint parts, put together by
    union. Rows without a model are left out.
    """
    keys = [key for key in models if key[1] > 0 or nonveg]
    if not keys:
        return obs.where(F.lit(False)).withColumn("lai_real", F.lit(None).cast("double"))
    return retrieve_kept(keep_by_key(obs.where(reduce(lambda a, b: a | b, map(_is_key, keys))), ["sensor", "biome"]), models, nonveg, features)


def retrieve_kept(kept: DataFrame, models: dict[tuple[str, int], RandomForestRegressionModel], nonveg: bool = False, features: list[str] = FEATURES) -> DataFrame:
    """retrieve on observations that lie in folders by key already; at least one model is used."""
    keys = sorted(key for key in models if key[1] > 0 or nonveg)
    return reduce(DataFrame.unionByName, [predict(models[key], kept.where(_is_key(key)), features=features) for key in keys])


def _is_key(key: tuple[str, int]) -> Column:
    return (F.col("sensor") == key[0]) & (F.col("biome") == key[1])


def select_by_biome(obs: DataFrame, candidates: dict[int, str], out: str = "lai_real") -> DataFrame:
    """Of one candidate column for each biome, the one of the row's biome; masked candidates and other biomes leave NULL."""
    value = F.lit(None).cast("double")
    for biome, column in sorted(candidates.items()):
        value = where_valid(value, F.col("biome") == biome, F.col(column))
    return obs.withColumn(out, value)
