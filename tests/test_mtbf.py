import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.plans.mtbf import mtbf, mtbf_periods

SCHEMA = "host string, cpu int, second bigint"


def errors(spark, at, rows):
    """(host, cpu, second) rows as memory errors."""
    msg = F.concat(F.lit("EDAC 1 CE memory read error on CPU#"), F.col("cpu"), F.lit(" (x)"))
    return (
        spark.createDataFrame(rows, SCHEMA)
        .select("host", at().alias("timestamp"), msg.alias("msg"))
        .withColumn("year", F.date_format("timestamp", "yyyy"))
        .withColumn("month", F.date_format("timestamp", "MM"))
    )


def naive(rows):
    """Host by host and percentile by percentile, row by row; one month only."""
    result = {}
    for host in {host for host, _, _ in rows}:
        kept = []
        for cpu in {cpu for h, cpu, _ in rows if h == host}:
            times = sorted(s for h, c, s in rows if h == host and c == cpu)
            kept += [(later, later - earlier) for earlier, later in zip(times, times[1:])]
        if host is None or len(kept) <= 5:
            result[host, "nopercetil"] = (0, 0, 0.0)
            continue
        kept.sort(key=lambda pair: pair[0])
        for index, threshold in enumerate(np.percentile([g for _, g in kept], [25, 50, 75, 90])):
            starts, total = {}, 0
            for second in sorted({s for s, _ in kept}):
                total += sum(g >= threshold for s, g in kept if s == second)
                starts.setdefault(total, second)
            gaps = np.diff(sorted(starts.values()))
            mean = float(gaps.mean()) if len(gaps) > 2 else None
            result[host, f"percentil_{index}"] = (len(kept), len(starts), mean)
    return result


def found(frame):
    rows = frame.collect()
    assert len({(r.period, r.host, r.percentile) for r in rows}) == len(rows)
    return {
        (r.host, r.percentile): (r.count_before, r.count_after, r.mtbf_seconds) for r in rows
    }


def assert_same(ours, expected):
    assert ours.keys() == expected.keys()
    for key, (before, after, mean) in expected.items():
        assert ours[key][:2] == (before, after), key
        assert ours[key][2] == (None if mean is None else pytest.approx(mean)), key


@pytest.mark.parametrize("seed", range(4))
def test_equals_naive_loop(spark, at, seed):
    rng = random.Random(seed)
    rows = []
    for host in ["a", "b", "c", "d"]:
        for cpu in range(rng.randint(1, 3)):
            span = rng.choice([40, 400, 100000])
            rows += [(host, cpu, rng.randint(0, span)) for _ in range(rng.randint(1, 40))]
    frame = errors(spark, at, rows)
    assert_same(found(mtbf(frame)), naive(rows))
    assert_same(found(mtbf(frame.orderBy(F.rand()).repartition(5))), naive(rows))


CASES = {
    "five gaps": [("h", 0, s) for s in (0, 1, 2, 3, 4, 5)],
    "six gaps": [("h", 0, s) for s in (0, 1, 2, 3, 4, 5, 6)],
    "all at once": [("h", 0, 7)] * 9,
    "one event per cpu": [("h", cpu, cpu) for cpu in range(9)],
    "same second on two cpus": [("h", c, s) for c in (0, 1) for s in (0, 10, 20, 20, 50, 90)],
    "gap equal to threshold": [("h", 0, s) for s in (0, 10, 20, 30, 40, 50, 60, 70)],
    "few bursts": [("h", 0, s) for s in (0, 1, 2, 3, 4, 5, 1000, 1001, 1002, 5000)],
    "unknown host": [(None, 0, s) for s in range(20)] + [("h", 0, s * s) for s in range(9)],
}


@pytest.mark.parametrize("name", CASES)
def test_edges(spark, at, name):
    assert_same(found(mtbf(errors(spark, at, CASES[name]))), naive(CASES[name]))


def test_one_crowded_second(spark, at):
    """A third of the errors with a broken clock does not change the others' bursts."""
    rows = [("h", 0, 0)] * 500 + [("h", 0, s) for s in range(1000, 11000, 10)]
    assert_same(found(mtbf(errors(spark, at, rows))), naive(rows))


def test_months_are_separate(spark, at):
    december, january = 1640995000, 1640995300  # around 1 January 2022
    rows = [("h", 0, december + s) for s in (0, 9, 11, 20, 31, 45, 60, 61)]
    rows += [("h", 0, january + s) for s in (0, 5, 17, 18, 40, 77, 80, 99)]
    both = {(r.period, r.percentile): r for r in mtbf(errors(spark, at, rows)).collect()}
    assert {period for period, _ in both} == {"202112", "202201"}
    for first, count in ((december, 8), (january, 8)):
        part = [row for row in rows if first <= row[2] < first + 300]
        assert len(part) == count
        expected = naive(part)
        period = "202112" if first == december else "202201"
        for (_, percentile), values in expected.items():
            row = both[period, percentile]
            assert (row.count_before, row.count_after) == values[:2]
    only = mtbf_periods(errors(spark, at, rows), "202201", "202212").collect()
    assert {r.period for r in only} == {"202201"}


def test_noise_and_null_messages_are_left_out(spark, at):
    rows = [("h", 0, s) for s in range(0, 90, 10)]
    frame = errors(spark, at, rows)
    noise = frame.withColumn("msg", F.lit("EDAC HANDLING MCE MEMORY ERROR on CPU#0 (x)"))
    empty = frame.withColumn("msg", F.lit(None).cast("string"))
    assert found(mtbf(frame.unionByName(noise).unionByName(empty))) == found(mtbf(frame))


def test_number_partitions(spark, at):
    frame = errors(spark, at, [("h", 0, s) for s in range(0, 90, 10)])
    numbers = frame.withColumns({n: F.col(n).cast("int") for n in ("year", "month")})
    assert mtbf(numbers).first().period == mtbf(frame).first().period == "197001"
