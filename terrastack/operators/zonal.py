"""Reducers over zones, and zone tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.schemas import EXCLUDED_ZONES, MONTH_LABELS
from terrastack.sources.shared import shared_folder


def statistics(value: str, percentiles: list[int] = ()) -> list[Column]:
    """mean, median and percentiles named <value>_<statistic>; exact, NULLs left out."""
    found = [F.avg(value).alias(f"{value}_mean"), F.percentile(value, F.lit(0.5)).alias(f"{value}_median")]
    return found + [F.percentile(value, F.lit(p / 100)).alias(f"{value}_p{p}") for p in percentiles]


def zonal(frame: DataFrame, value: str, by: list[str], percentiles: list[int] = ()) -> DataFrame:
    return frame.groupBy(*by).agg(*statistics(value, percentiles))


def month_label(month: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTH_LABELS)), month - 1)


def keep_zones(zones: DataFrame, code: str = "state", excluded: list = EXCLUDED_ZONES) -> DataFrame:
    """Rows whose zone code is not excluded."""
    return zones.where(~F.col(code).isin(excluded))


def pick_zone(codes: DataFrame, index: int, override: str = "", code: str = "state") -> DataFrame:
    """The zone code at a place of the sorted list, clamped to its ends; an override wins. `codes` is a table of zones, some dozens of rows."""
    if override:
        return codes.select(F.lit(override).alias(code)).limit(1)
    one = codes.select(code).distinct().agg(F.array_sort(F.collect_list(code)).alias("all_"))
    return one.select(F.get("all_", F.greatest(F.least(F.lit(index), F.size("all_") - 1), F.lit(0))).alias(code))


def bounds(pixels: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return pixels.groupBy(*by).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def dissolve(pixels: DataFrame, membership: DataFrame, state: str = "state") -> DataFrame:
    """region, pixel_id: the distinct pixels of each region's member states. Regions may overlap; whether `membership` (region, state) is broadcast goes by its size."""
    return pixels.join(membership, state).select("region", "pixel_id").distinct()


def ranked(frame: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ordinal, 0 first, without bringing all rows into one task: rows are dealt to ranges of the order, sorted within them, and numbered from the sizes of the ranges before.

    The dealt rows are written to the checkpoint folder once, so that sizes and places are of the same ranges. Rows that are equal in `order` come in any order.
    """
    shared_folder(frame.sparkSession)
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())  # range << 33, plus the place in it
    dealt = dealt.withColumns({"range_": F.shiftright("at_", 33).cast("int"), "at_": F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    sizes = dict(dealt.groupBy("range_").count().collect())  # a row for each range
    before, total = [], 0
    for number in range(max(sizes, default=0) + 1):
        before.append(str(total))
        total += sizes.get(number, 0)
    start = F.get(F.split(F.lit(",".join(before)), ",").cast("array<long>"), F.col("range_"))
    return dealt.withColumn("ordinal", (start + F.col("at_")).cast("int")).drop("range_", "at_")
