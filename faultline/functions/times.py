"""Time buckets, month limits and units."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


WINDOW_SIZE = re.compile(r"\s*0*([1-9][0-9]*)\s+(?:(minutes?|mins?)|hours?)\s*")


def parse_window_size(text: str) -> int:
    """'30 minutes', '1 hour' and the like to seconds; sizes below 1 are errors."""
    size = WINDOW_SIZE.fullmatch(text)
    if size is None:
        raise ValueError(f"a positive number of minutes or hours is needed, not {text!r}")
    return int(size[1]) * (60 if size[2] else 3600)


def bucket_seconds(timestamp: Column | str, seconds: int) -> Column:
    """Epoch seconds at which the epoch-aligned bucket starts; NULL stays NULL."""
    second = F.unix_seconds(F.col(timestamp) if isinstance(timestamp, str) else timestamp)
    return second - F.pmod(second, F.lit(seconds).cast("bigint"))


def time_bucket(timestamp: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket; NULL stays NULL."""
    return F.timestamp_seconds(bucket_seconds(timestamp, seconds))


def windows_ending_before(bucket: Column, bucket_seconds: int, window: int, span: int) -> Column:
    """Starts of the windows that end at a bucket or up to ``span`` seconds before it.

    All times are epoch seconds, windows start at multiples of their size, and window and
    span are multiples of the bucket. The array has at most ceil(span / window) items.
    """
    latest = bucket - window
    latest = latest - F.pmod(latest, F.lit(window))
    count = (span - bucket_seconds) // window + 1
    starts = F.array(*[latest - step * window for step in range(count)])
    return F.filter(starts, lambda start: start + window + span > bucket)


def shift_seconds(timestamp: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return timestamp + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1)).cast("timestamp")


def month_bounds(year: Column, month: Column) -> list[Column]:
    """First instant of the month and of the next one, and the next month's numbers."""
    first = F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
    following = F.add_months(first, 1)
    return [
        first.cast("timestamp").alias("month_start"),
        following.cast("timestamp").alias("month_end"),
        F.year(following).alias("next_year"),
        F.month(following).alias("next_month"),
    ]


def month_after(year: int, month: int) -> tuple[int, int]:
    following = dt.date(year, month, 28) + dt.timedelta(days=7)
    return following.year, following.month


def in_time_range(timestamp: Column, start: Column, end: Column) -> Column:
    """Half-open: the start belongs to the range, the end does not."""
    return (timestamp >= start) & (timestamp < end)


def gap_minutes(seconds: Column) -> Column:
    return F.round(seconds / 60, 2)


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds / 60


def seconds_to_hours(seconds: Column) -> Column:
    return seconds / 3600


def parse_period(period: Column) -> Column:
    """'yyyyMM', or 'yyyyM' without padding, to the first day of that month."""
    year = F.substring(period, 1, 4).try_cast("int")
    month = F.substring(period, 5, 2).try_cast("int")
    return F.make_date(year, month, F.lit(1))


def format_period(date: Column) -> Column:
    return F.date_format(date, "yyyyMM")
