"""Bursts and MTBF run by run: what a run needs to know of earlier ones is stored with them.

A *run* is a stretch of time, such as a day or a month, with a name that sorts in time order. It
reads its own errors and the small tables that earlier runs left in a folder, never their
errors. Its own tables are partitions of that folder, so a run that is done again replaces
them; later runs must then be done again too. Errors of two runs share no second.

Results over any number of runs are sums of these tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.plans.bursts import second_bursts, second_counts
from faultline.plans.mtbf import HOST, error_seconds, gap_counts, mtbf_of, second_gaps, second_maxima
from faultline.sinks.tables import write_partitioned, written_table

CPU = [*HOST, "cpu_info"]


def write_part(table: DataFrame, folder: str, name: str, run: str) -> None:
    rows = table.withColumn("run", F.lit(run)).hint("rebalance", "run")
    write_partitioned(rows, f"{folder}/{name}", ["run"])


def earlier_parts(spark: SparkSession, folder: str, name: str, schema: str, run: str) -> DataFrame | None:
    """Rows of the runs before ``run``; None if there is no such table yet."""
    try:
        parts = spark.read.schema(f"{schema}, run string").parquet(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return parts.where(F.col("run") < run)


LAST_SECONDS = "period string, host string, cpu_info string, second bigint"


def add_mtbf_run(errors: DataFrame, folder: str, run: str) -> None:
    """Adds a run's errors: counts of gaps, seconds by largest gap, each CPU's last second.

    Gaps go on from the last second that earlier runs of the same month saw.
    """
    spark = errors.sparkSession
    seconds = written_table(error_seconds(errors), "seconds")
    before = earlier_parts(spark, folder, "last", LAST_SECONDS, run)
    known = seconds
    if before is not None:
        # Only months that the run has errors of; a month that is over needs no state.
        months = before.join(seconds.select("period").distinct(), "period", "left_semi")
        heads = months.groupBy(*CPU).agg(F.max("second").alias("second"))
        known = seconds.unionByName(heads.withColumn("errors", F.lit(0).cast("bigint")))
    gaps = written_table(second_gaps(known), "gaps")
    counts = gap_counts(gaps).groupBy(*HOST, "gap").agg(F.sum("n").alias("n"))
    write_part(counts, folder, "counts", run)
    write_part(second_maxima(gaps), folder, "maxima", run)
    write_part(seconds.groupBy(*CPU).agg(F.max("second").alias("second")), folder, "last", run)


def mtbf_of_runs(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """``mtbf_periods`` from the tables of all runs, months ``first`` to ``last`` (yyyyMM)."""
    wanted = F.col("period").between(first, last)
    counts = spark.read.schema("period string, host string, gap bigint, n bigint").parquet(f"{folder}/counts")
    maxima = spark.read.schema(
        "period string, host string, largest bigint, seconds bigint, first bigint, last bigint"
    ).parquet(f"{folder}/maxima")
    merged = maxima.where(wanted).groupBy(*HOST, "largest").agg(
        F.sum("seconds").alias("seconds"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return mtbf_of(counts.where(wanted), merged)


LAST_BURST = "timestamp timestamp, group_id bigint"


def add_burst_run(
    errors: DataFrame,
    folder: str,
    run: str,
    threshold: int = fixed.GLOBAL_BURST_SECONDS,
    tie: Sequence[str] = ("host", "msg"),
) -> None:
    """Adds a run's errors to the burst table; a burst that was open goes on in it."""
    spark = errors.sparkSession
    before = earlier_parts(spark, folder, "ends", LAST_BURST, run)
    end = before.orderBy(F.desc("timestamp")).first() if before is not None else None
    seconds = second_counts(errors, tie, continued=end is not None)
    opened = 0
    if end is not None:
        opened = end["group_id"]
        zero = F.lit(0).cast("bigint")
        head = before.where(F.col("run") == end["run"]).select(
            "timestamp", *[zero.alias(name) for name in ("rows", "messages", "ce", "ce_rows")]
        )
        seconds = seconds.unionByName(head)
    bursts = second_bursts(seconds, threshold).groupBy(
        (F.col("group_id") + opened).cast("bigint").alias("group_id")
    ).agg(
        F.min("timestamp").alias("min_timestamp"),
        F.sum("messages").alias("messages"), F.sum("ce").alias("ce"), F.sum("ce_rows").alias("ce_rows"),
    )
    bursts = written_table(bursts, "run-bursts")
    write_part(bursts, folder, "bursts", run)
    latest = seconds.agg(F.max("timestamp").alias("timestamp")).where("timestamp is not null")
    number = bursts.agg(F.coalesce(F.max("group_id"), F.lit(opened).cast("bigint"))).scalar()
    write_part(latest.select("timestamp", number.alias("group_id")), folder, "ends", run)


def bursts_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``burst_table`` from the tables of all runs: a burst over several runs is one row."""
    parts = spark.read.schema(
        "group_id bigint, min_timestamp timestamp, messages bigint, ce bigint, ce_rows bigint"
    ).parquet(f"{folder}/bursts")
    return parts.groupBy("group_id").agg(
        F.min("min_timestamp").alias("min_timestamp"),
        F.when(F.sum("ce_rows") > 0, F.sum("ce")).alias("number_ce_error"),
        F.sum("messages").alias("count"),
    )
