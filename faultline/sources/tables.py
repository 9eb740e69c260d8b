"""Readers of log and feature tables. Dates select partitions before any file is opened."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline import schemas
from faultline.fixed_values import LOOKAHEAD_SECONDS
from faultline.functions.times import month_after
from faultline.operators.filters import filter_exclude_noise, filter_partition_eq
from faultline.operators.sets import DATE_PARTITIONS

Month = tuple[int, int]


def read_files(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """Parquet files by path or wildcard, as ``schema``.

    A given schema would read a column that the files do not have as NULL, so their own
    schema is looked at first; a column that is missing there is an error.
    """
    stored = {name.lower() for name in spark.read.options(**options).parquet(path).columns}
    missing = [name for name in schema.names if name.lower() not in stored]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return spark.read.schema(schema).options(**options).parquet(path)


def read_table(spark: SparkSession, source: str, schema: StructType | None = None) -> DataFrame:
    """A metastore table by name, or Parquet by path; see ``read_files`` for ``schema``."""
    if "/" not in source:
        return spark.table(source)
    if schema is None:
        return spark.read.parquet(source)
    return read_files(spark, source, schema)


def partition_date() -> Column:
    return F.make_date(*[F.col(name).cast("int") for name in DATE_PARTITIONS])


def scan_logs_range(
    spark: SparkSession,
    source: str,
    date_from: str,
    date_to: str,
    schema: StructType | None = schemas.RAW_LOGS,
) -> DataFrame:
    """Log records of all days from ``date_from`` to ``date_to`` (yyyyMMdd, both included).

    The plain condition on ``year`` lets a metastore prune before dates are computed.
    """
    first, last = (dt.datetime.strptime(text, "%Y%m%d").date() for text in (date_from, date_to))
    return (
        read_table(spark, source, schema)
        .where(F.col("year").between(f"{first.year:04d}", f"{last.year:04d}"))
        .where(partition_date().between(F.lit(first), F.lit(last)))
    )


def scan_typed_range(spark: SparkSession, source: str, date_from: str, date_to: str) -> DataFrame:
    """Typed logs of a range of days, with the mark of memory errors where the table has one."""
    marked = schemas.MEMORY_ERROR_MARK in read_table(spark, source).columns
    schema = schemas.MARKED_LOGS if marked else schemas.TYPED_LOGS
    return scan_logs_range(spark, source, date_from, date_to, schema)


def scan_empty_like(table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame([], table.schema)


def scan_parquet_month(spark: SparkSession, root: str, year: int, month: int) -> DataFrame:
    """One month of typed logs without the partition columns."""
    table = read_table(spark, root, schemas.TYPED_LOGS)
    return filter_partition_eq(table, year, month).drop(*DATE_PARTITIONS)


def scan_optional(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> DataFrame | None:
    """The table at a path, None if the path does not exist. Other errors are raised."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def instant(utc: dt.datetime) -> Column:
    """A literal timestamp that does not depend on the time zone of the driver's machine."""
    return F.timestamp_seconds(F.lit(calendar.timegm(utc.timetuple())))


def months_with_lookahead(
    logs: DataFrame, first: Month, last: Month, window_seconds: int
) -> DataFrame:
    """Rows of a range of months, and what the labels of its last windows need after it.

    One read: whole days follow from the partition columns, the exact end from the
    timestamp. Months that do not exist simply match nothing.
    """
    begin = dt.date(*first, 1)
    end = dt.datetime(*month_after(*last), 1)
    overlap_end = end + dt.timedelta(seconds=window_seconds + LOOKAHEAD_SECONDS)
    days = partition_date()
    before_end = days < F.lit(end.date())
    return (
        logs.where(F.col("year").between(f"{begin.year:04d}", f"{overlap_end.year:04d}"))
        .where(days.between(F.lit(begin), F.lit(overlap_end.date())))
        .where(before_end | (F.col("timestamp") < instant(overlap_end)))
    )


def scan_with_lookahead(
    spark: SparkSession, root: str, year: int, month: int, window_seconds: int
) -> DataFrame:
    logs = read_table(spark, root, schemas.TYPED_LOGS)
    month_logs = months_with_lookahead(logs, (year, month), (year, month), window_seconds)
    return month_logs.drop(*DATE_PARTITIONS)


def scan_parquet_filtered(
    spark: SparkSession, path: str, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Memory errors without noise, of one month or of all months."""
    errors = read_table(spark, path, schemas.MEMORY_ERRORS)
    if year is not None and month is not None:
        errors = filter_partition_eq(errors, year, month)
    return filter_exclude_noise(errors)


def scan_feature_dataset(spark: SparkSession, glob: str, base_path: str) -> DataFrame:
    """Feature files by wildcard, with the partition columns found below ``base_path``.

    A column that the files do not have is an error.
    """
    return read_files(spark, glob, schemas.FEATURES, basePath=base_path)
