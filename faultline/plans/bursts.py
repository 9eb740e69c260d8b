"""Bursts over all errors of all hosts: errors less than a fixed time apart.

The messages are read once, into a table of per-second counts that is stored and then
used by every further step. It has at most one row per second of the log, so bursts of a
year need 32 million small rows, however many errors there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.parse import number_ce_error
from faultline.operators.filters import filter_exclude_noise
from faultline.operators.ordering import running_over_chunks
from faultline.sinks.tables import written_table


def error_rows(errors: DataFrame, tie: Sequence[str]) -> DataFrame:
    msg = F.col("msg")
    rows = filter_exclude_noise(errors).where(F.col("timestamp").isNotNull())
    return rows.select(
        *dict.fromkeys(["timestamp", *tie]),
        # An extracted field is NULL only where the message is, so none is extracted here.
        msg.isNotNull().cast("int").alias("_messages"),
        number_ce_error(msg).try_cast("bigint").alias("_ce"),
    )


def second_counts(
    errors: DataFrame, tie: Sequence[str], continued: bool = False
) -> DataFrame:
    """Per second: rows, rows with a message, and the error numbers, without the first row.

    The first row of all has no gap and belongs to no burst. Of several rows in the first
    second, ``tie`` decides which one that is. Rows that are ``continued`` follow others, so
    all of them count.
    """
    rows = error_rows(errors, tie)
    zero = F.lit(0).cast("bigint")
    head = F.struct("_messages", "_ce")
    counts = written_table(
        rows.groupBy("timestamp").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("_messages").alias("messages"),
            F.coalesce(F.sum("_ce"), zero).alias("ce"),
            F.count("_ce").alias("ce_rows"),
            # What each second's first row holds: one of these seconds is the first of all.
            F.min_by(head, F.struct(*tie, "_messages", "_ce")).alias("head"),
        ),
        "second-counts",
    )
    if continued:
        return counts.drop("head")
    first, dropped = counts.agg(
        F.unix_micros(F.min("timestamp")), F.min_by("head", "timestamp")
    ).first()
    is_first = F.col("timestamp") == F.timestamp_micros(F.lit(first).cast("bigint"))
    messages, ce = dropped if dropped else (0, None)
    less = {"rows": 1, "messages": messages, "ce": ce or 0, "ce_rows": int(ce is not None)}
    # The emptied first second stays in the table: the next second's gap starts there.
    return counts.select(
        "timestamp",
        *[
            (F.col(name) - F.when(is_first, amount).otherwise(0)).cast("bigint").alias(name)
            for name, amount in less.items()
        ],
    )


def second_bursts(seconds: DataFrame, threshold: int) -> DataFrame:
    """Seconds with the number of their burst."""
    day = F.to_date("timestamp")
    zero = F.lit(0).cast("bigint")
    gaps = running_over_chunks(
        seconds, [], order=["timestamp"], chunk=day, last="timestamp"
    )
    gap = F.unix_seconds("timestamp") - F.unix_seconds("previous")
    repeats = F.when(F.col("previous").isNull(), F.col("rows")).otherwise(F.col("rows") - 1)
    flags = F.when(gap >= threshold, 1).otherwise(0) + F.when(
        F.lit(threshold <= 0), repeats
    ).otherwise(zero)
    flagged = gaps.withColumn("flags", flags.cast("bigint")).drop("previous")
    numbered = running_over_chunks(
        flagged, [], order=["timestamp"], chunk=day, amounts=["flags"]
    )
    return numbered.where("rows > 0").select(
        "timestamp",
        "messages",
        "ce",
        "ce_rows",
        (F.col("flags_before") + F.col("flags")).alias("group_id"),
    )


def burst_table(
    errors: DataFrame,
    threshold: int = fixed.GLOBAL_BURST_SECONDS,
    tie: Sequence[str] = ("host", "msg"),
) -> DataFrame:
    """Per burst: start, sum of the error numbers (NULL without any), number of rows."""
    seconds = second_counts(errors, tie)
    ce: Column = F.when(F.sum("ce_rows") > 0, F.sum("ce"))
    return (
        second_bursts(seconds, threshold)
        .groupBy("group_id")
        .agg(
            F.min("timestamp").alias("min_timestamp"),
            ce.alias("number_ce_error"),
            F.sum("messages").alias("count"),
        )
    )
