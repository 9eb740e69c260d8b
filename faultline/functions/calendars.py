"""Calendar columns of the error profiles and of the model matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import fixed_values as fixed


def calendar_columns(timestamp: Column) -> list[Column]:
    return [
        F.hour(timestamp).alias("hour"),
        F.dayofweek(timestamp).alias("day_of_week"),
        F.date_format(timestamp, "E").alias("day_name"),
        F.dayofmonth(timestamp).alias("day_of_month"),
        F.month(timestamp).alias("month_number"),
        F.date_format(timestamp, "MMMM").alias("month_name"),
        F.to_date(timestamp).alias("date"),
    ]


def day_type(timestamp: Column) -> Column:
    is_weekday = F.dayofweek(timestamp).isin(*fixed.WEEKDAY_NUMBERS)
    return F.when(is_weekday, fixed.WEEKDAY_NAME).otherwise(fixed.WEEKEND_NAME)


def month_third(timestamp: Column) -> Column:
    start, middle, end = fixed.MONTH_THIRDS
    day = F.dayofmonth(timestamp)
    return F.when(day <= 10, start).when(day <= 20, middle).otherwise(end)


def percentile_label(key: Column) -> Column:
    """Display name of a percentile key, NULL for an unknown one."""
    pairs = [F.lit(text) for pair in fixed.PERCENTILE_LABELS.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def time_features(timestamp: Column) -> list[Column]:
    """Model inputs; here Monday is 0, unlike in the calendar profiles."""
    hour, weekday = F.hour(timestamp), F.weekday(timestamp)
    return [
        hour.alias("hour"),
        weekday.alias("dayofweek"),
        ((hour <= 6) | (hour >= 22)).cast("int").alias("is_night"),
        (weekday >= 5).cast("int").alias("is_weekend"),
    ]
