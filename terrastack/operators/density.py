"""Observation density: clear counts, means over years, regional statistics, gap fractions.

Counts are zero where a pixel was never seen: the table of pixels, not the observations, says which rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.functions.masks import clear_sky
from terrastack.operators.zonal import month_label, zonal
from terrastack.params import DensityParams
from terrastack.sources.catalog import filter_cloud

PERCENTILES = [10, 25, 75, 90]


def clear_rows(obs: DataFrame, scenes: DataFrame, params: DensityParams = DensityParams(), placeholder: str | None = None) -> DataFrame:
    """pixel_id, year, month of each clear observation in the years asked for. `placeholder` names a band that must not be masked.

    Scenes are filtered and cut to two columns before the join, observations to the bits that matter.
    """
    stamp = F.col("time_start")
    kept = filter_cloud(scenes, params.cloud_limit).where(stamp.between(F.lit(f"{params.first_year}-01-01").cast("timestamp_ntz"), F.lit(f"{params.last_year}-12-31 23:59:59.999999").cast("timestamp_ntz")))
    dated = kept.select("scene_id", F.year(stamp).alias("year"), F.month(stamp).alias("month"))
    clear = obs.where(clear_sky(F.col("qa_pixel")))
    if placeholder:
        clear = clear.where(F.col(placeholder).isNotNull())
    return clear.select("scene_id", "pixel_id").join(dated, "scene_id").select("pixel_id", "year", "month")


def clear_obs_count(clear: DataFrame, pixels: DataFrame, params: DensityParams = DensityParams()) -> DataFrame:
    """pixel_id, year, month, obs_count: one row for each pixel and month of all years (with zero_fill), else for those seen."""
    counts = clear.groupBy("pixel_id", "year", "month").agg(F.count(F.lit(1)).alias("obs_count"))
    if not params.zero_fill:
        return counts.join(pixels.select("pixel_id"), "pixel_id", "left_semi")
    years = F.explode(F.sequence(F.lit(params.first_year), F.lit(params.last_year))).alias("year")
    dense = pixels.select("pixel_id", years).select("pixel_id", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return dense.join(counts, ["pixel_id", "year", "month"], "left").withColumn("obs_count", F.coalesce("obs_count", F.lit(0).cast("long")))


def mean_obs_count(clear: DataFrame, pixels: DataFrame, params: DensityParams = DensityParams()) -> DataFrame:
    """`pixels` with month and obs_count: the mean over all years of each calendar month's counts.

    With zero filling the mean is the total divided by the number of years, so one row of twelve totals a pixel is shuffled and joined, and
    years are never spelt out.
    """
    if not params.zero_fill:
        counts = clear_obs_count(clear, pixels, params)
        return pixels.join(counts.groupBy("pixel_id", "month").agg(F.avg("obs_count").alias("obs_count")), "pixel_id")
    totals = clear.groupBy("pixel_id").agg(*[F.count(F.when(F.col("month") == m, 1)).alias(f"m{m}_") for m in range(1, 13)])
    joined = pixels.join(totals, "pixel_id", "left")
    rows = F.array(*[F.struct(F.lit(m).alias("month"), (F.coalesce(F.col(f"m{m}_"), F.lit(0).cast("long")) / F.lit(float(params.years))).alias("obs_count")) for m in range(1, 13)])
    return joined.select(*pixels.columns, F.explode(rows).alias("r")).select(*pixels.columns, "r.month", "r.obs_count")


def monthly_obs_stats(mean_counts: DataFrame) -> DataFrame:
    """month_num, month_label, then mean, median and percentiles of the pixels' mean counts."""
    found = zonal(mean_counts, "obs_count", ["month"], PERCENTILES)
    return found.select(F.col("month").alias("month_num"), month_label(F.col("month")).alias("month_label"), *[c for c in found.columns if c != "month"])


def regional_obs_stats(mean_counts: DataFrame, membership: DataFrame, state: str = "state") -> DataFrame:
    """region, month_num, month_label, mean and median. A pixel counts in every region that holds its state; whether `membership` is broadcast goes by its size."""
    found = zonal(mean_counts.join(membership, state), "obs_count", ["region", "month"])
    return found.select("region", F.col("month").alias("month_num"), month_label(F.col("month")).alias("month_label"), "obs_count_mean", "obs_count_median")


def regional_single_year(counts: DataFrame, membership: DataFrame, year: int, months: list[int], state: str = "state") -> DataFrame:
    """region, year, month, mean and median of one year's counts (pixel_id, state, year, month, obs_count)."""
    some = counts.where((F.col("year") == year) & F.col("month").isin(months))
    return zonal(some.join(membership, state), "obs_count", ["region", "year", "month"])


def gap_fraction(mean_counts: DataFrame, thresholds: dict[str, float] | None = None, mask: Column | None = None) -> DataFrame:
    """month_num, month_label and, for each threshold, the share of pixels whose mean count is below it. `mask` says which pixels count."""
    names = {"gap": 1.0, "gap_lt2": 2.0} if thresholds is None else thresholds
    some = mean_counts if mask is None else mean_counts.where(mask)
    found = some.groupBy("month").agg(*[F.avg((F.col("obs_count") < t).cast("double")).alias(n) for n, t in names.items()])
    return found.select(F.col("month").alias("month_num"), month_label(F.col("month")).alias("month_label"), *names)


def write_csv(table: DataFrame, path: str, selectors: list[str]) -> None:
    """A report of a few dozen rows as one CSV file with a header, columns in the order asked for."""
    table.select(*selectors).coalesce(1).write.mode("overwrite").csv(path, header=True)
