"""Row filters. All of them are plain predicates, so Catalyst can push them to the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.times import in_time_range
from faultline.schemas import MEMORY_ERROR_MARK


def filter_partition_eq(
    table: DataFrame, year: int, month: int, day: int | None = None
) -> DataFrame:
    """Rows of one month or day; partition values are zero-padded text."""
    wanted = {"year": f"{year:04d}", "month": f"{month:02d}"}
    if day is not None:
        wanted["day"] = f"{day:02d}"
    for name, value in wanted.items():
        table = table.where(F.col(name) == value)
    return table


def filter_host(table: DataFrame, host: str | None) -> DataFrame:
    return table if host is None else table.where(F.col("host") == F.lit(host))


def filter_host_prefixes(
    table: DataFrame, prefixes: Iterable[str] = fixed.HOST_PREFIXES
) -> DataFrame:
    return table.where(reduce(or_, [F.col("host").startswith(prefix) for prefix in prefixes]))


def is_memory_error(msg: Column | str = "msg") -> Column:
    """Whether a message reports a memory error; NULL for NULL."""
    msg = F.col(msg) if isinstance(msg, str) else msg
    return F.upper(msg).like(fixed.UPPER_MESSAGE_LIKE) & F.lower(msg).like(fixed.LOWER_MESSAGE_LIKE)


def filter_memory_errors(table: DataFrame) -> DataFrame:
    """Memory errors. A table that carries the mark is filtered by it.

    The first condition on the mark reaches the scan, which skips files, row groups and pages
    without errors before it reads a message. Rows that were written before there was a mark
    have none, and their messages are looked at.
    """
    if MEMORY_ERROR_MARK not in table.columns:
        return table.where(is_memory_error())
    mark = F.col(MEMORY_ERROR_MARK)
    return table.where(mark | mark.isNull()).where(F.coalesce(mark, is_memory_error()))


def filter_exclude_noise(table: DataFrame) -> DataFrame:
    """Drops the handler's own announcements; a NULL message is dropped too."""
    return table.where(~F.col("msg").like(fixed.NOISE_MESSAGE_LIKE))


def filter_not_null(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col(name).isNotNull())


def filter_time_range(table: DataFrame, name: str, start: Column, end: Column) -> DataFrame:
    return table.where(in_time_range(F.col(name), start, end))


def filter_in_list(table: DataFrame, name: str, values: Iterable[str] | None) -> DataFrame:
    """Rows whose value is in the list; no list keeps all rows."""
    return table if values is None else table.where(F.col(name).isin(list(values)))


def filter_class(table: DataFrame, label: str, value: int) -> DataFrame:
    return table.where(F.col(label) == value)
