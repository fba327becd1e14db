"""Monthly composites of retrievals, with counts and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.functions.masks import qa_valid
from terrastack.params import CompositeParams


def valid_retrievals(retrievals: DataFrame, nonveg: bool = False) -> DataFrame:
    """Rows whose flags allow them; pixels without vegetation only if `nonveg`."""
    kept = retrievals.where(qa_valid(F.col("qa")))
    return kept if nonveg else kept.where(F.col("biome") > 0)


def reducer(value: Column, name: str) -> Column:
    return F.percentile(value, F.lit(0.5)) if name == "median" else F.avg(value)


def monthly(retrievals: DataFrame, params: CompositeParams = CompositeParams()) -> DataFrame:
    """pixel_id, year, month, lai, obs_count: the reduced value (floored to an integer) and how many retrievals it rests on."""
    valid = valid_retrievals(retrievals, params.nonveg)
    keys = "pixel_id", F.year("time_start").alias("year"), F.month("time_start").alias("month")
    found = valid.groupBy(*keys).agg(reducer(F.col("lai"), params.reducer).alias("lai"), F.count("lai").alias("obs_count"))
    return found.withColumn("lai", F.floor("lai").cast("int"))


def monthly_dense(retrievals: DataFrame, pixels: DataFrame, months: list[tuple[int, int]], params: CompositeParams = CompositeParams()) -> DataFrame:
    """As `monthly`, with a row for every pixel of `pixels` in every (year, month): a NULL value and count 0 where there is nothing."""
    wanted = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y, m in months])
    dense = pixels.select("pixel_id", F.explode(wanted).alias("c")).select("pixel_id", "c.year", "c.month")
    found = dense.join(monthly(retrievals, params), ["pixel_id", "year", "month"], "left")
    return found.withColumn("obs_count", F.coalesce("obs_count", F.lit(0).cast("long")))


def properties(year: Column, month: Column, state: Column, params: CompositeParams = CompositeParams()) -> dict[str, Column]:
    """The eleven properties of a composite."""
    start = F.make_date(year, month, F.lit(1))
    end = F.add_months(start, 1)
    millis = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return {
        "system_index": F.date_format(start, "yyyyMM"),
        "state": state,
        "year": year,
        "month": month,
        "start": millis(start),
        "end": millis(end),
        "LAI_scale_factor": F.lit(1 / params.encode_scale),
        "composite_reducer": F.lit(params.reducer),
        "nonveg": F.lit(params.nonveg),
        "cloud_limit": F.lit(params.cloud_limit),
        "LAI_version": F.lit(params.version),
    }


def export_name(state: Column, year: Column, month: Column) -> Column:
    return F.concat_ws("_", F.lit("LAI"), state, year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def density_name(month: Column, year: Column | None = None) -> Column:
    parts = [F.lit("obscount_CONUS"), *([] if year is None else [year.cast("string")]), F.lpad(month.cast("string"), 2, "0")]
    return F.concat_ws("_", *parts)


def write_partitioned(composite: DataFrame, path: str) -> None:
    """Composites in folders by state, year and month; each folder's rows come from few tasks."""
    composite.repartition("state", "year", "month").write.mode("overwrite").partitionBy("state", "year", "month").parquet(path)
