"""Mean time between failure bursts per month, host and gap percentile.

An error's gap is the time since the previous error of the same CPU in that month. A gap
at or above a percentile of the host's gaps starts a burst, and the MTBF is the mean time
between burst starts.

All hosts and months are computed in one job. Only whole seconds matter, so errors are
counted per second before anything is sorted: however many errors a host has, a month of
one CPU is at most 2.7 million rows. The counts of hosts' distinct gaps, on which
percentiles and bursts are computed, are smaller still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.parse import error_field
from faultline.operators.aggregates import agg_percentiles, explode_thresholds
from faultline.operators.filters import filter_exclude_noise

HOST = ["period", "host"]


def period_column() -> Column:
    """yyyyMM from the partition columns, whether padded text or numbers."""
    return F.concat(F.col("year"), F.lpad(F.col("month").cast("string"), 2, "0"))


def error_seconds(errors: DataFrame) -> DataFrame:
    """Per CPU and second with errors: their number. Needs host, msg, timestamp, year, month."""
    return (
        filter_exclude_noise(errors)
        .where(F.col("timestamp").isNotNull())
        .groupBy(
            period_column().alias("period"),
            "host",
            error_field("cpu_info", F.col("msg")).alias("cpu_info"),
            F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("second"),
        )
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def second_gaps(seconds: DataFrame) -> DataFrame:
    """Per CPU and second: the gap of the first error and the number of others.

    The others follow within the second and have gap 0. The first error of a CPU has no gap.
    A second without errors only tells where the next gap starts.
    """
    by_cpu = Window.partitionBy("period", "host", "cpu_info").orderBy("second")
    gap = F.col("second") - F.lag("second").over(by_cpu)
    return (
        seconds.withColumn("gap", gap)
        .where("errors > 0")
        .select(*HOST, "second", "gap", (F.col("errors") - 1).alias("repeats"))
    )


def gap_counts(gaps: DataFrame) -> DataFrame:
    """How often each gap occurs on a host; a host without any keeps a zero count."""
    by_gap = gaps.groupBy(*HOST, "gap").agg(
        F.count("gap").alias("firsts"), F.sum("repeats").alias("repeats")
    )
    zero = F.lit(0).cast("bigint")
    pairs = F.array(
        F.struct(F.col("gap").alias("gap"), F.col("firsts").alias("n")),
        F.struct(zero.alias("gap"), F.col("repeats").alias("n")),
    )
    return by_gap.select(*HOST, F.inline(pairs))


def second_maxima(gaps: DataFrame) -> DataFrame:
    """Host seconds grouped by their largest gap, the only thing a threshold looks at."""
    gap = F.greatest(F.col("gap"), F.when(F.col("repeats") > 0, 0))
    return (
        gaps.groupBy(*HOST, "second")
        .agg(F.max(gap).alias("largest"))
        .where(F.col("largest").isNotNull())
        .groupBy(*HOST, "largest")
        .agg(
            F.count(F.lit(1)).alias("seconds"),
            F.min("second").alias("first"),
            F.max("second").alias("last"),
        )
    )


def mtbf(errors: DataFrame) -> DataFrame:
    """One row per (period, host, percentile); a host with too few gaps gets one row.

    ``status`` is sparse, few_bursts (no MTBF) or ok.
    """
    gaps = second_gaps(error_seconds(errors))
    return mtbf_of(gap_counts(gaps), second_maxima(gaps))


def mtbf_of(counts: DataFrame, maxima: DataFrame) -> DataFrame:
    """The same from counts of gaps and from seconds by largest gap, of one run or several."""
    percentiles = agg_percentiles(counts, HOST, "gap", "n")
    # A NULL host is many unknown hosts, so it never has enough gaps of its own.
    sparse = (F.col("gaps") <= fixed.MIN_GAPS_EXCLUSIVE) | F.col("host").isNull()
    no_threshold = F.array(F.lit(None).cast("double"))
    thresholds = explode_thresholds(
        percentiles.withColumn("sparse", sparse).withColumn(
            "thresholds", F.when(F.col("sparse"), no_threshold).otherwise(F.col("thresholds"))
        )
    )
    maxima = maxima.withColumnsRenamed({name: f"_{name}" for name in HOST})
    same_host = F.col("period").eqNullSafe(F.col("_period")) & F.col("host").eqNullSafe(
        F.col("_host")
    )
    starts_burst = F.col("largest") >= F.col("threshold_seconds")
    bursts = (
        thresholds.join(maxima, same_host, "left")
        .groupBy(*HOST, "sparse", "percentile", "threshold_seconds", "gaps")
        .agg(
            F.sum(F.when(starts_burst, F.col("seconds")).otherwise(0)).alias("flagged"),
            F.min("first").alias("first"),
            F.min_by("largest", "first").alias("first_largest"),
            F.max(F.when(starts_burst, F.col("last"))).alias("last"),
        )
    )
    # The first second opens a burst whether or not its gap reaches the threshold.
    opens_unflagged = (F.col("first_largest") < F.col("threshold_seconds")).cast("bigint")
    count_after = F.col("flagged") + opens_unflagged
    burst_gaps = count_after - 1
    has_mtbf = burst_gaps > fixed.MIN_BURST_GAPS_EXCLUSIVE
    keys = F.array(*[F.lit(key) for key in fixed.PERCENTILE_KEYS])

    def unless_sparse(value: Column, default: Column) -> Column:
        return F.when(F.col("sparse"), default).otherwise(value)

    zero = F.lit(0).cast("bigint")
    return bursts.select(
        *HOST,
        unless_sparse(
            F.element_at(keys, F.col("percentile") + 1), F.lit(fixed.SPARSE_KEY)
        ).alias("percentile"),
        "threshold_seconds",
        unless_sparse(F.col("gaps"), zero).alias("count_before"),
        unless_sparse(count_after, zero).alias("count_after"),
        unless_sparse(
            F.when(has_mtbf, (F.col("last") - F.col("first")) / burst_gaps), F.lit(0.0)
        ).alias("mtbf_seconds"),
        unless_sparse(F.when(has_mtbf, "ok").otherwise("few_bursts"), F.lit("sparse")).alias(
            "status"
        ),
    )


def mtbf_periods(errors: DataFrame, first: str, last: str) -> DataFrame:
    """The same for all months from ``first`` to ``last`` (yyyyMM, both included)."""
    in_years = F.col("year").between(first[:4], last[:4])
    return mtbf(errors.where(in_years & period_column().between(first, last)))
