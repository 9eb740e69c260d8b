"""Collection jobs: raw log table to typed logs or to memory errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.functions.parse import normalize_logs
from faultline.operators.filters import (
    filter_host,
    filter_host_prefixes,
    filter_memory_errors,
)
from faultline.sinks.tables import sink_memory_errors, sink_typed_logs
from faultline.sources.tables import scan_logs_range, scan_typed_range

ERROR_COLUMNS = ["timestamp", "host", "msg", "year", "month", "day"]


def typed_logs(raw: DataFrame) -> DataFrame:
    return normalize_logs(raw)


def memory_errors(raw: DataFrame, host: str | None = None) -> DataFrame:
    typed = filter_host_prefixes(filter_host(normalize_logs(raw), host))
    return filter_memory_errors(typed).select(*ERROR_COLUMNS)


def typed_memory_errors(
    spark: SparkSession, typed: str, date_from: str, date_to: str, host: str | None = None
) -> DataFrame:
    """Memory errors out of typed logs, where the mark lets the scan skip all other messages."""
    rows = scan_typed_range(spark, typed, date_from, date_to)
    return filter_memory_errors(filter_host_prefixes(filter_host(rows, host))).select(*ERROR_COLUMNS)


def collect_typed_logs(
    spark: SparkSession, source: str, path: str, date_from: str, date_to: str
) -> None:
    sink_typed_logs(typed_logs(scan_logs_range(spark, source, date_from, date_to)), path)


def collect_memory_errors(
    spark: SparkSession,
    source: str,
    path: str,
    date_from: str,
    date_to: str,
    host: str | None = None,
) -> None:
    raw = scan_logs_range(spark, source, date_from, date_to)
    sink_memory_errors(memory_errors(raw, host), path)


def collect_typed_memory_errors(
    spark: SparkSession, typed: str, path: str, date_from: str, date_to: str, host: str | None = None
) -> None:
    """The table of ``collect_memory_errors``, from typed logs instead of raw ones."""
    sink_memory_errors(typed_memory_errors(spark, typed, date_from, date_to, host), path)
