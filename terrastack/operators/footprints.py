"""Which boxes overlap: a spatial join of scene footprints with zones, without comparing all with all.

Boxes are put into squares of a hierarchy of grids, each with squares twice as large as the one below. A box lies on the level whose squares are about its size, so it touches four of them at most,
and is looked up on all coarser levels too. Two boxes meet on the level of the larger one: never twice on different levels, and on that level only in the square that holds the lower left corner of
what they share. Small boxes never meet small ones on a coarse level, so one large box does not bring all small ones together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Levels: the coarsest squares are 2^(LEVELS - 1) times the base; larger boxes touch more than four of those.
LEVELS = 16


def _squares(boxes: DataFrame, base: float, prefix: str) -> DataFrame:
    """A row for each level and square that a box is looked up in: its own level and all coarser ones. Boxes with a null or not finite side, or turned inside out, are left out."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in BOX]
    sound = finite[0] & finite[1] & finite[2] & finite[3] & (F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax"))
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / base
    own = F.when(size <= 1, 0).otherwise(F.least(F.ceil(F.log2(size)).cast("int"), F.lit(LEVELS - 1))).alias("own")
    kept = boxes.where(sound).select(F.struct(*boxes.columns).alias(prefix), own, *[F.col(c).alias(f"{prefix}_{c}") for c in BOX])
    placed = kept.withColumn("level", F.explode(F.sequence("own", F.lit(LEVELS - 1))))
    side = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"{prefix}_{low}") / side), F.floor(F.col(f"{prefix}_{high}") / side)))
    return placed.withColumn("sx", span("xmin", "xmax")).withColumn("sy", span("ymin", "ymax"))


def overlapping(a: DataFrame, b: DataFrame, base: float) -> DataFrame:
    """a, b (structs of whole rows) of each pair of boxes (xmin, ymin, xmax, ymax, ...) that share a point, each pair of rows once.

    `base` is the size of the finest squares, about that of the most common boxes. Touching counts; equal rows pair each.
    """
    left, right = _squares(a, base, "a"), _squares(b, base, "b")
    keys = ["level", "sx", "sy"]
    larger_a = left.where("own = level").drop("own").join(right.drop("own"), keys)
    larger_b = left.where("own < level").drop("own").join(right.where("own = level").drop("own"), keys)
    met = larger_a.unionByName(larger_b)
    share = [F.col(f"a_{low}") <= F.col(f"b_{high}") for low, high in (("xmin", "xmax"), ("ymin", "ymax"))] + [F.col(f"b_{low}") <= F.col(f"a_{high}") for low, high in (("xmin", "xmax"), ("ymin", "ymax"))]
    side = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / side)
    found: Column = (corner("xmin") == F.col("sx")) & (corner("ymin") == F.col("sy"))
    for test in share:
        found = found & test
    return met.where(found).select("a", "b")


def scenes_meeting(scenes: DataFrame, footprints: DataFrame, boxes: DataFrame, base: float) -> DataFrame:
    """`scenes` whose footprint (scene_id and its box) meets one of `boxes`: no observation is read."""
    found = overlapping(footprints.select("scene_id", *BOX), boxes.select(*BOX), base)
    return scenes.join(found.select("a.scene_id"), "scene_id", "left_semi")
