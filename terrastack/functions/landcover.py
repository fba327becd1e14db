"""Land-cover epochs and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.schemas import BIOME_OF_CLASS, EPOCH_YEARS


def epoch_of_year(year: Column, strict: bool = False) -> Column:
    """The epoch that stands for a year; NULL outside 1984 to 2024, or an error if `strict`."""
    found = F.coalesce(*[F.when(year.between(first, last), F.lit(epoch)) for first, last, epoch in EPOCH_YEARS])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no land-cover epoch for year "), year.cast("string"))).cast("int")) if strict else found


def biome_of_class(landcover: Column) -> Column:
    """Biome 0 to 8; classes that are not listed are masked."""
    table = F.create_map(*[F.lit(x) for pair in BIOME_OF_CLASS.items() for x in pair])
    return F.try_element_at(table, landcover.cast("int"))


def is_vegetated(landcover: Column) -> Column:
    """1 or 0; NULL for classes that are not listed."""
    return (biome_of_class(landcover) > 0).cast("int")


def first_release(cover: DataFrame) -> DataFrame:
    """pixel_id, epoch, landcover: of several releases of an epoch the one of the lowest release_rank."""
    return cover.where(F.col("landcover").isNotNull()).groupBy("pixel_id", "epoch").agg(F.min_by("landcover", "release_rank").alias("landcover"))


def with_land_cover(obs: DataFrame, cover: DataFrame) -> DataFrame:
    """`obs` (pixel_id, time_start) with the class and biome of its year's epoch; masked where `cover` has none."""
    dated = obs.withColumn("epoch", epoch_of_year(F.year("time_start")))
    return dated.join(first_release(cover), ["pixel_id", "epoch"], "left").withColumn("biome", biome_of_class(F.col("landcover")))
