"""Retrieval quality: hull lookup, range test, flag bits, integer encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.schemas import FLAG_HULL, FLAG_NONVEG, FLAG_RANGE, LAI_LIMIT, REFLECTANCE_LIMIT

#: The hull's axes, the first one counting most.
AXES = ["red", "green", "nir", "swir1"]
BINS = 10


def in_reflectance_range() -> Column:
    """All four bands at least 0 and below their limit."""
    tests = [(F.col(b) >= 0) & (F.col(b) < REFLECTANCE_LIMIT[b]) for b in AXES]
    return tests[0] & tests[1] & tests[2] & tests[3]


def hull_index() -> Column:
    """Cell of the 10 x 10 x 10 x 10 table; NULL outside the range."""
    index = F.lit(0)
    for band in AXES:
        index = index * BINS + F.floor(F.col(band) / REFLECTANCE_LIMIT[band] * BINS).cast("int")
    return F.when(in_reflectance_range(), index)


def with_hull(obs: DataFrame, hull: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`obs` with in_hull (1 or 0). Cells that the table lacks, and observations out of range, are outside.

    `hull` has hull_index, in_hull and `keys` (such as sensor): 10,000 cells for each sensor; whether it is broadcast goes by its size.
    """
    on = ["hull_index", *(keys or [])]
    found = obs.withColumn("hull_index", hull_index()).join(hull.select(*on, F.col("in_hull").alias("hull_")), on, "left")
    return found.withColumn("in_hull", F.coalesce("hull_", F.lit(0))).drop("hull_")


def quality_flags(lai: Column, in_hull: Column, biome: Column) -> Column:
    """Bit 0: outside the hull. Bit 1: LAI outside 0 to 8. Bit 2: not vegetated. Masked where the LAI is."""
    outside = F.when(in_hull == 0, FLAG_HULL).otherwise(0)
    beyond = F.when((lai >= 0) & (lai <= LAI_LIMIT), 0).otherwise(FLAG_RANGE)
    bare = F.when(biome == 0, FLAG_NONVEG).otherwise(0)
    return F.when(lai.isNotNull(), outside.bitwiseOR(beyond).bitwiseOR(bare))


def encode(lai: Column, scale: float = 100.0) -> Column:
    """Rounded, scaled, and held within 16 bits; masked where the LAI is (least and greatest would pass over NULL)."""
    return F.when(lai.isNotNull(), F.least(F.greatest(F.round(lai * scale), F.lit(0)), F.lit(65535)).cast("int"))


def decode(code: Column, scale: float = 0.01) -> Column:
    return code * F.lit(scale)
