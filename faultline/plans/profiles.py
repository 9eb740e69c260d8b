"""Calendar profiles of bursts. Their results have one row per hour, day or month."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.calendars import day_type, month_third
from faultline.operators.aggregates import agg_count_by, agg_pivot_heatmap
from faultline.session import require_utc


def in_utc(profile: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The profile, refused in a session whose hours are not those of UTC."""

    @wraps(profile)
    def checked(bursts: DataFrame) -> DataFrame:
        require_utc(bursts.sparkSession)
        return profile(bursts)

    return checked


@in_utc
def profile_hour(bursts: DataFrame) -> DataFrame:
    return agg_count_by(bursts, F.hour("min_timestamp").alias("hour")).orderBy("hour")


@in_utc
def profile_hour_daytype(bursts: DataFrame) -> DataFrame:
    return agg_count_by(
        bursts,
        F.hour("min_timestamp").alias("hour"),
        day_type(F.col("min_timestamp")).alias("day_type"),
    )


@in_utc
def profile_day_of_month(bursts: DataFrame) -> DataFrame:
    day = F.dayofmonth("min_timestamp").alias("day_of_month")
    return agg_count_by(bursts, day).orderBy("day_of_month")


@in_utc
def profile_month_third(bursts: DataFrame) -> DataFrame:
    return agg_count_by(bursts, month_third(F.col("min_timestamp")).alias("month_third"))


@in_utc
def profile_month(bursts: DataFrame) -> DataFrame:
    return agg_count_by(
        bursts,
        F.month("min_timestamp").alias("month_number"),
        F.date_format("min_timestamp", "MMMM").alias("month_name"),
    ).orderBy("month_number")


@in_utc
def daily_series(bursts: DataFrame) -> DataFrame:
    """Bursts per day from the first day to the last, 0 on days without."""
    counts = agg_count_by(bursts, F.to_date("min_timestamp").alias("date"))
    days = bursts.agg(
        F.to_date(F.min("min_timestamp")).alias("first"),
        F.to_date(F.max("min_timestamp")).alias("last"),
    ).where(F.col("first").isNotNull())
    calendar = days.select(F.explode(F.sequence("first", "last")).alias("date"))
    return calendar.join(counts, "date", "left").fillna({"count": 0}).orderBy("date")


def moving_average(series: DataFrame, days: int = fixed.SEASON_DAYS) -> DataFrame:
    """Adds ``trend``: the centred mean of ``days`` (odd) rows, NULL at both ends.

    The series has one row per day, so one task can hold it.
    """
    half = days // 2
    centred = Window.orderBy("date").rowsBetween(-half, half)
    complete = F.count("count").over(centred) == days
    return series.withColumn("trend", F.when(complete, F.avg("count").over(centred)))


def seasonal_decompose(series: DataFrame, days: int = fixed.SEASON_DAYS) -> DataFrame:
    """Additive decomposition: trend, a repeating season that sums to 0, and the rest."""
    from_first = F.datediff("date", F.min("date").over(Window.partitionBy()))
    placed = moving_average(series, days).withColumn("position", F.pmod(from_first, F.lit(days)))
    by_position = Window.partitionBy("position")
    means = placed.withColumn(
        "_mean", F.avg(F.col("count") - F.col("trend")).over(by_position)
    ).withColumn("_first", F.row_number().over(by_position.orderBy("date")) == 1)
    # Every position counts once in the overall mean, however many days it has.
    overall = F.avg(F.when(F.col("_first"), F.col("_mean"))).over(Window.partitionBy())
    return means.select(
        "date",
        "count",
        "trend",
        (F.col("_mean") - overall).alias("seasonal"),
        (F.col("count") - F.col("trend") - (F.col("_mean") - overall)).alias("residual"),
    ).orderBy("date")


@in_utc
def heatmap_day_hour(bursts: DataFrame) -> DataFrame:
    return agg_pivot_heatmap(bursts)
