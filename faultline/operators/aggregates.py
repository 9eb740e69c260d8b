"""Grouped summaries. Each lets Spark combine rows before it shuffles them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.times import time_bucket

#: Share of all rows above which a host is spread over salts.
HOT_SHARE = 0.01
#: Hosts that the sketch follows for each that can be hot; its error is a part of the share.
TRACKED_PER_HOT = 20
#: Entries of a quantile sketch: at 2,000 a percentile is off by 0.2 % of the rows or less.
SKETCH_ENTRIES = 2000


def agg_window_features(flagged: DataFrame, window_seconds: int) -> DataFrame:
    """Per (window, host): log and error counts, severity mean and maximum, error label."""
    return (
        flagged.withColumn("feature_window_start", time_bucket("timestamp", window_seconds))
        .groupBy("feature_window_start", "host")
        .agg(
            F.count(F.lit(1)).alias("num_logs"),
            F.sum("is_error").alias("num_errors"),
            F.avg("Severity").alias("avg_severity"),
            F.max("Severity").alias("max_severity"),
            F.max("is_error").alias("label_feature_window"),
        )
    )


def hot_hosts(rows: DataFrame, share: float = HOT_SHARE) -> Column:
    """Hosts that hold more than ``share`` of all rows, found by a sketch of heavy hitters.

    The sketch is merged from partial ones and follows far more hosts than can be hot, so no hot
    host is missed; the list has at most ``1 / share`` hosts, whatever the data.
    """
    most = math.ceil(1 / share)
    top = F.expr(f"approx_top_k(host, {most}, {TRACKED_PER_HOT * most})")
    return (
        rows.agg(top.alias("top"), F.count(F.lit(1)).alias("total"))
        .select(
            F.transform(
                F.filter("top", lambda entry: entry["count"] > share * F.col("total")),
                lambda entry: entry["item"],
            )
        )
        .scalar()
    )


def salted_parts(
    flagged: DataFrame, window_seconds: int, salts: int = 120, share: float = HOT_SHARE
) -> DataFrame:
    """Partial features per (window, host, salt); only hot hosts have more than one salt.

    The salt is a hash of the row, so a lost task recomputes the same rows.
    """
    salt = F.pmod(F.xxhash64("host", "timestamp", "Severity", "msg"), F.lit(salts))
    hot = F.array_contains(hot_hosts(flagged, share), F.col("host"))
    return (
        flagged.withColumn("salt", F.when(hot, salt).otherwise(0))
        .withColumn("feature_window_start", time_bucket("timestamp", window_seconds))
        .groupBy("feature_window_start", "host", "salt")
        .agg(*partial_features())
    )


def agg_two_phase_salted(
    flagged: DataFrame, window_seconds: int, salts: int = 120, share: float = HOT_SHARE
) -> DataFrame:
    """The same table in two steps, first per salt, for engines without map-side combine.

    Hosts are looked at first: only those with more than ``share`` of the rows are spread over
    ``salts``, so keys of ordinary hosts are not multiplied. Sum and count travel separately,
    so the mean is the mean of all rows.
    """
    parts = salted_parts(flagged, window_seconds, salts, share)
    return parts.groupBy("feature_window_start", "host").agg(*merged_features())


def partial_features() -> list[Column]:
    """Summaries that can be merged again: the mean as its sum and count."""
    return [
        F.count(F.lit(1)).alias("logs"),
        F.sum("is_error").alias("errors"),
        F.sum("Severity").alias("severity_sum"),
        F.count("Severity").alias("severity_count"),
        F.max("Severity").alias("severity_max"),
        F.max("is_error").alias("error_max"),
    ]


def merged_features() -> list[Column]:
    return [
        F.sum("logs").alias("num_logs"),
        F.sum("errors").alias("num_errors"),
        F.try_divide(F.sum("severity_sum"), F.sum("severity_count")).alias("avg_severity"),
        F.max("severity_max").alias("max_severity"),
        F.max("error_max").alias("label_feature_window"),
    ]


def agg_hourly_target(flagged: DataFrame) -> DataFrame:
    """Per (clock hour, host): whether the host had an error."""
    return (
        flagged.withColumn(
            "target_window_start", time_bucket("timestamp", fixed.LOOKAHEAD_SECONDS)
        )
        .groupBy("target_window_start", "host")
        .agg(F.max("is_error").alias("label_next_hour"))
    )


def agg_distinct_hosts(table: DataFrame) -> DataFrame:
    return table.select("host").distinct()


def agg_percentiles(
    gaps: DataFrame,
    keys: Sequence[str],
    gap: str = "time_diff_seconds",
    frequency: str | int = 1,
    probabilities: Sequence[float] = fixed.GAP_PERCENTILES,
) -> DataFrame:
    """Exact, linearly interpolated percentiles per key.

    ``frequency`` is how often a row counts. Whole-second gaps have few distinct values,
    which is what the aggregate keeps in memory.
    """
    weight = F.lit(frequency) if isinstance(frequency, int) else F.col(frequency)
    return gaps.groupBy(*keys).agg(
        F.percentile(gap, list(probabilities), weight).alias("thresholds"),
        F.sum(F.when(F.col(gap).isNotNull(), weight).otherwise(0)).cast("bigint").alias("gaps"),
    )


def gap_sketches(
    gaps: DataFrame, keys: Sequence[str], gap: str = "time_diff_seconds", entries: int = SKETCH_ENTRIES
) -> DataFrame:
    """A quantile sketch of the gaps per key, of bounded size, that can be stored and merged.

    For gaps finer than seconds, whose distinct values the exact aggregate would all keep, and
    for ranges of months: each month is read once and its sketches are kept.
    """
    value = F.col(gap).cast("double")
    return gaps.groupBy(*keys).agg(
        F.kll_sketch_agg_double(value, F.lit(entries)).alias("sketch"),
        F.count(gap).alias("gaps"),
    )


def merged_percentiles(
    sketches: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float] = fixed.GAP_PERCENTILES,
) -> DataFrame:
    """Percentiles per key from stored sketches, of one month or of many.

    Each is a gap that occurs. Its rank is off by about 2 / entries of the rows at most (0.2 % for
    2,000 entries, with 99 % confidence); sketches of fewer gaps than entries are exact.
    """
    merged = sketches.where("gaps > 0").groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("gaps").alias("gaps")
    )
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.select(
        *keys, F.kll_sketch_get_quantile_double("sketch", wanted).alias("thresholds"), "gaps"
    )


def explode_thresholds(percentiles: DataFrame) -> DataFrame:
    """One row per percentile with its number and value in place of the list."""
    others = [name for name in percentiles.columns if name != "thresholds"]
    return percentiles.select(
        *others, F.posexplode("thresholds").alias("percentile", "threshold_seconds")
    )


def agg_bursts(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per burst: start, number of rows with a message, sum of the error numbers."""
    return grouped.groupBy(*keys).agg(
        F.min("timestamp").alias("min_timestamp"),
        F.count("err_code").alias("count"),
        F.sum(F.col("number_ce_error").try_cast("bigint")).alias("number_ce_error"),
    )


def agg_mean_gap(starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean gap between consecutive burst starts, NULL with too few bursts.

    Gaps between sorted starts add up to last minus first, so no sort is needed.
    """
    start = F.unix_seconds(F.col("min_timestamp").cast("timestamp"))
    gaps = F.count("min_timestamp") - 1
    return starts.groupBy(*keys).agg(
        gaps.alias("burst_gaps"),
        F.when(
            gaps > fixed.MIN_BURST_GAPS_EXCLUSIVE, (F.max(start) - F.min(start)) / gaps
        ).alias("mtbf_seconds"),
    )


def agg_count_by(table: DataFrame, *keys: Column | str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def agg_collect_periods(results: DataFrame) -> DataFrame:
    """Per (host, percentile): its months in order, and how many. Months are few."""
    return results.groupBy("host", "percentile").agg(
        F.sort_array(F.collect_list("period")).alias("periods"),
        F.count("period").alias("size"),
    )


def agg_class_stats(rows: DataFrame, split: str, label: str = "label_next_hour") -> DataFrame:
    """Per split: rows, positives, negatives, positive rate, negatives per positive."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.avg(label).alias("positive_rate"),
        F.try_divide(negatives, positives).alias("negatives_per_positive"),
    )


def agg_pivot_heatmap(starts: DataFrame, timestamp: str = "min_timestamp") -> DataFrame:
    """Weekday by hour matrix of row counts, Monday first, 0 where there are none."""
    weekdays = F.array(*[F.lit(name) for name in fixed.WEEKDAY_ORDER])
    order = starts.sparkSession.range(1).select(
        F.posexplode(weekdays).alias("day_order", "day_name")
    )
    hours = list(range(24))
    counts = (
        starts.select(
            F.date_format(timestamp, "E").alias("day_name"), F.hour(timestamp).alias("hour")
        )
        .groupBy("day_name")
        .pivot("hour", hours)
        .agg(F.count(F.lit(1)))
    )
    names = {str(hour): f"h{hour:02d}" for hour in hours}
    matrix = order.join(counts.withColumnsRenamed(names), "day_name", "left")
    return matrix.fillna(0, list(names.values())).orderBy("day_order")
