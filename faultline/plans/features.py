"""Features per (time window, host) with a label: does an error follow within an hour?

One pass over the logs and no join. Logs are first summed into the largest time buckets
that fit both the window and the hour. A bucket then contributes its sums to the window
that contains it, and its error flag to the windows that it labels; both kinds of
contribution meet in a single aggregation by window start. Busy hosts are combined before
each shuffle, so no key is ever large.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.parse import classify_error, error_flag, host_or_unknown, severity_int
from faultline.functions.times import (
    bucket_seconds,
    in_time_range,
    month_after,
    windows_ending_before,
)
from faultline.operators.aggregates import merged_features, partial_features
from faultline.operators.columns import error_ratio
from faultline.session import require_utc
from faultline.sources.tables import Month, months_with_lookahead

HOUR = fixed.LOOKAHEAD_SECONDS
MODES = ("aligned", "rolling")


def flag_logs(typed: DataFrame) -> DataFrame:
    """Typed logs to what features need."""
    msg = F.col("msg")
    return typed.select(
        host_or_unknown(F.col("host")).alias("host"),
        "timestamp",
        severity_int(F.col("Severity")).alias("Severity"),
        "msg",
        error_flag(classify_error(msg)).alias("is_error"),
    )


def no_starts() -> Column:
    return F.array().cast("array<bigint>")


def label_starts(bucket: Column, window: int, bucket_seconds: int, mode: str) -> Column:
    """Starts of the windows of one size that an error in a bucket makes positive.

    aligned: the error's clock hour must begin where the window ends, so a window that
    ends off the hour is never positive. rolling: the hour after the window's end counts,
    wherever that is.
    """
    if mode == "aligned":
        start = bucket - F.pmod(bucket, F.lit(HOUR)) - window
        return F.when(F.pmod(start, F.lit(window)) == 0, F.array(start)).otherwise(no_starts())
    # Only errors matter here, as there is no target hour to report.
    starts = windows_ending_before(bucket, bucket_seconds, window, HOUR)
    return F.when(F.col("error_max") == 1, starts).otherwise(no_starts())


def contribution(window: int, start: Column, is_label: bool) -> Column:
    return F.struct(
        F.lit(window).alias("window_seconds"),
        start.cast("bigint").alias("start"),
        F.lit(is_label).alias("is_label"),
    )


def label_contributions(window: int, starts: Column) -> Column:
    return F.transform(starts, lambda start: contribution(window, start, True))


def window_features(
    flagged: DataFrame, windows: Sequence[int], mode: str = "aligned"
) -> DataFrame:
    """Features and label for every window size, host and window start with logs."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    size = gcd(HOUR, *windows)
    buckets = (
        flagged.where(F.col("timestamp").isNotNull())  # such rows belong to no window
        .withColumn("bucket", bucket_seconds("timestamp", size))
        .groupBy("host", "bucket")
        .agg(*partial_features())
    )
    bucket = F.col("bucket")
    hour = bucket - F.pmod(bucket, F.lit(HOUR))

    contributions = []
    for window in windows:
        own = contribution(window, bucket - F.pmod(bucket, F.lit(window)), False)
        labels = label_contributions(window, label_starts(bucket, window, size, mode))
        contributions += [F.array(own), labels]

    measures = ["logs", "errors", "severity_sum", "severity_count", "severity_max"]
    is_label = F.col("is_label")
    spread = buckets.select(
        "host", "bucket", *measures, "error_max", F.inline(F.concat(*contributions))
    )
    combined = spread.select(
        "host",
        "window_seconds",
        "start",
        *[F.when(~is_label, F.col(name)).alias(name) for name in measures],
        F.when(~is_label, F.col("error_max")).alias("error_max"),
        F.when(is_label, F.col("error_max")).alias("next_error"),
        F.when(is_label & F.lit(mode == "aligned"), hour).alias("target"),
    )
    return (
        combined.groupBy("host", "window_seconds", "start")
        .agg(
            *merged_features(),
            F.coalesce(F.max("next_error"), F.lit(0)).alias("label_next_hour"),
            F.timestamp_seconds(F.max("target")).alias("target_window_start"),
        )
        .where(F.col("num_logs").isNotNull())
        .select(
            "window_seconds",
            "host",
            F.timestamp_seconds("start").alias("feature_window_start"),
            "num_logs",
            "num_errors",
            "avg_severity",
            "max_severity",
            "label_feature_window",
            "target_window_start",
            "label_next_hour",
            error_ratio(F.col("num_errors"), F.col("num_logs")).alias("error_ratio"),
        )
    )


def feature_dataset_periods(
    typed: DataFrame,
    first: Month,
    last: Month,
    windows: Sequence[int],
    mode: str = "aligned",
) -> DataFrame:
    """Feature rows of all months from ``first`` to ``last`` for all window sizes.

    ``typed`` is a typed log table with its partition columns.
    """
    require_utc(typed.sparkSession)
    logs = months_with_lookahead(typed, first, last, max(windows))
    year, month = month_after(*last)
    start = F.col("feature_window_start")
    return (
        window_features(flag_logs(logs), windows, mode)
        .where(
            in_time_range(
                start,
                F.lit(f"{first[0]:04d}-{first[1]:02d}-01").cast("timestamp"),
                F.lit(f"{year:04d}-{month:02d}-01").cast("timestamp"),
            )
        )
        .withColumns(
            {"year": F.date_format(start, "yyyy"), "month": F.date_format(start, "MM")}
        )
    )


def feature_dataset(
    typed: DataFrame, year: int, month: int, window_seconds: int, mode: str = "aligned"
) -> DataFrame:
    """Feature rows of one month for one window size."""
    rows = feature_dataset_periods(
        typed, (year, month), (year, month), [window_seconds], mode
    )
    return rows.drop("window_seconds")

