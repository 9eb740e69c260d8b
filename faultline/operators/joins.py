"""Labels for feature windows."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.times import shift_seconds, time_bucket, windows_ending_before


def join_features_target(
    features: DataFrame, hourly: DataFrame, window_seconds: int
) -> DataFrame:
    """Features with the error flag of the clock hour that starts where the window ends.

    A window that does not end on a whole hour, or whose next hour has no logs, gets 0.
    """
    shifted = hourly.withColumn(
        "feature_window_start", shift_seconds(F.col("target_window_start"), -window_seconds)
    )
    joined = features.join(shifted, ["host", "feature_window_start"], "left")
    return joined.fillna({"label_next_hour": 0})


def next_hour_label_rolling(
    features: DataFrame, flagged: DataFrame, window_seconds: int
) -> DataFrame:
    """Features with 1 where the host has an error in the hour after the window's end.

    Errors are first reduced to distinct (host, bucket) pairs, with buckets that fit both
    the window and the hour. A bucket names the few windows that it labels, and these join
    by equality, so there is no range join and no window over a host.
    """
    hour = fixed.LOOKAHEAD_SECONDS
    size = gcd(hour, window_seconds)
    starts = windows_ending_before(F.col("bucket"), size, window_seconds, hour)
    labelled = (
        flagged.where("is_error = 1")
        .withColumn("bucket", F.unix_seconds(time_bucket("timestamp", size)))
        .select("host", "bucket")
        .distinct()
        .select("host", F.explode(starts).alias("start"))
        .distinct()
        .select(
            "host",
            F.timestamp_seconds("start").alias("feature_window_start"),
            F.lit(1).alias("label_next_hour"),
        )
    )
    joined = features.join(labelled, ["host", "feature_window_start"], "left")
    return joined.fillna({"label_next_hour": 0})
