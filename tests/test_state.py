"""Runs that go on from stored tables give what one job over everything gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.plans import state
from faultline.plans.bursts import burst_table
from faultline.plans.mtbf import mtbf_periods

HOSTS = ["c201", "c202", None]


def errors(spark, seed, days, count):
    rng, rows = random.Random(seed), []
    at = dt.datetime(2024, 1, 29, 23, 59, 50)
    for _ in range(count):
        at += dt.timedelta(seconds=rng.choice([0, 0, 1, 2, 4, 5, 6, 300, 86400 * days // count * 2]))
        msg = f"EDAC {rng.choice(['', 3, 7])} CE memory read error on CPU#{rng.randrange(2)} (slot:0)"
        rows.append((at, rng.choice(HOSTS), msg, f"{at:%Y}", f"{at:%m}", f"{at:%d}"))
    return spark.createDataFrame(rows, "timestamp timestamp, host string, msg string, year string, month string, day string")


def as_set(table):
    return sorted(map(str, table.select(sorted(table.columns)).collect()))


def runs_of(table, by):
    name = F.concat(*[F.col(c) for c in by])
    names = sorted(r[0] for r in table.select(name).distinct().collect())
    return [(n, table.where(name == n)) for n in names]


@pytest.mark.parametrize("seed, by", [(1, ("year", "month")), (2, ("year", "month", "day"))])
def test_runs_equal_the_whole(spark, tmp_path, seed, by):
    table = errors(spark, seed, 4, 40).cache()
    folder = str(tmp_path / "state")
    for run, rows in runs_of(table, by):
        state.add_mtbf_run(rows, folder, run)
        state.add_burst_run(rows, folder, run)
    assert as_set(state.mtbf_of_runs(spark, folder, "202401", "202412")) == as_set(mtbf_periods(table, "202401", "202412"))
    assert as_set(state.bursts_of_runs(spark, folder)) == as_set(burst_table(table))
    table.unpersist()


def test_an_open_burst_goes_on_and_a_run_can_be_done_again(spark, tmp_path):
    at = dt.datetime(2024, 1, 31, 23, 59, 56)
    times = [at + dt.timedelta(seconds=s) for s in (0, 1, 3, 6, 8, 20, 86390, 86400 + 6)]
    rows = [(t, "c201", "EDAC 2 CE memory read error on CPU#0 (slot:0)", f"{t:%Y}", f"{t:%m}", f"{t:%d}") for t in times]
    table = spark.createDataFrame(rows, "timestamp timestamp, host string, msg string, year string, month string, day string")
    folder, parts = str(tmp_path / "state"), runs_of(table, ("month", "day"))
    assert len(parts) == 3
    empty = table.limit(0)
    state.add_burst_run(empty, folder, "0000")
    for run, part in [*parts, parts[-1]]:  # the last one twice
        state.add_burst_run(part, folder, run)
        state.add_mtbf_run(part, folder, run)
    state.add_burst_run(empty, folder, "9999")
    assert as_set(state.bursts_of_runs(spark, folder)) == as_set(burst_table(table))
    assert as_set(state.mtbf_of_runs(spark, folder, "202401", "202402")) == as_set(mtbf_periods(table, "202401", "202402"))
    first = state.bursts_of_runs(spark, folder).orderBy("group_id").first()
    assert first["count"] == 4  # over midnight


def test_a_run_does_not_read_old_errors(spark, tmp_path):
    source, folder = str(tmp_path / "errors"), str(tmp_path / "state")
    errors(spark, 5, 20, 60).write.partitionBy("year", "month").parquet(source)
    for month in ("01", "02"):
        rows = spark.read.parquet(f"{source}/year=2024/month={month}")
        rows = rows.withColumns({"year": F.lit("2024"), "month": F.lit(month)})
        state.add_mtbf_run(rows, folder, f"2024{month}")
        state.add_burst_run(rows, folder, f"2024{month}")
    whole = spark.read.schema("timestamp timestamp, host string, msg string, day string, year string, month string").parquet(source)
    assert as_set(state.bursts_of_runs(spark, folder)) == as_set(burst_table(whole))
