"""Extension: monthly counts and means kept up to date as observations arrive. Medians cannot be kept incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_running(stream: DataFrame, key: str, stamp: str, value: str, delay: str = "40 days") -> DataFrame:
    """Of a static table key, month, n, mean; of a stream key, day, n, total, whose state is dropped once rows `delay` late are past: months_of_days
    makes months of these.

    `stamp` is a time stamp with time zone (event time).
    """
    month = F.date_trunc("month", stamp)
    marked = stream.withWatermark(stamp, delay) if stream.isStreaming else stream
    # the window is a day wide so that the watermark can drop state; months are sums of days
    days = marked.groupBy(F.window(stamp, "1 day").alias("day"), F.col(key)).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    if stream.isStreaming:
        return days.select(key, F.col("day.start").alias("day"), "n", "total")
    months = stream.groupBy(F.col(key), month.alias("month")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return months


def months_of_days(days: DataFrame, key: str) -> DataFrame:
    """Monthly n and mean from the stream's daily rows."""
    found = days.groupBy(F.col(key), F.date_trunc("month", "day").alias("month")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return found.select(key, "month", "n", (F.col("total") / F.col("n")).alias("mean"))
