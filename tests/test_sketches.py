"""Heavy hitters and quantile sketches against exact forms."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from faultline.operators import aggregates


def flagged(spark, hosts):
    """One row for each name in ``hosts``, over three hours."""
    rows = [(h, i * 97 % 10800, i % 7, f"m{i}", int(i % 5 == 0)) for i, h in enumerate(hosts)]
    table = spark.createDataFrame(rows, "host string, second long, Severity int, msg string, is_error int")
    return table.withColumn("timestamp", F.timestamp_seconds("second")).repartition(6)


def as_set(table):
    return sorted(map(str, table.select(sorted(table.columns)).collect()))


EVEN = [f"h{i % 400}" for i in range(8000)]
SKEWED = ["busy"] * 4000 + ["second"] * 300 + [f"h{i % 400}" for i in range(3700)]


@pytest.mark.parametrize("hosts", [EVEN, SKEWED, ["one"] * 50, []])
def test_salted_sums_are_the_plain_ones(spark, hosts):
    rows = flagged(spark, hosts)
    assert as_set(aggregates.agg_two_phase_salted(rows, 3600)) == as_set(
        aggregates.agg_window_features(rows, 3600)
    )


def test_only_hot_hosts_are_salted(spark):
    even = aggregates.salted_parts(flagged(spark, EVEN), 3600)
    assert even.count() == flagged(spark, EVEN).select(F.floor(F.col("second") / 3600), "host").distinct().count()
    salts = aggregates.salted_parts(flagged(spark, SKEWED), 3600).groupBy("host").agg(
        F.count_distinct("salt").alias("salts"), F.sum("logs").alias("logs")
    )
    found = {r.host: (r.salts, r.logs) for r in salts.collect()}
    assert found["busy"] == (120, 4000) and found["second"][0] > 50
    assert all(salts == 1 for host, (salts, _) in found.items() if host[0] == "h")
    assert sorted(flagged(spark, SKEWED).select(aggregates.hot_hosts(flagged(spark, SKEWED))).first()[0]) == ["busy", "second"]


def gaps_of(spark, months):
    rng, rows = random.Random(6), []
    for month in range(months):
        for i in range(4000):
            rows.append((month, "a", rng.expovariate(0.01)))
            if i < 30:
                rows.append((month, "b", float(rng.randrange(5))))
    rows += [(0, "a", None), (0, "c", None)]
    return rows, spark.createDataFrame(rows, "month int, host string, time_diff_seconds double").repartition(5)


def test_sketches_of_months_merge_to_the_whole(spark):
    rows, gaps = gaps_of(spark, 6)
    stored = aggregates.gap_sketches(gaps, ["month", "host"])
    merged = {r.host: r for r in aggregates.merged_percentiles(stored, ["host"]).collect()}
    whole = {r.host: r for r in aggregates.agg_percentiles(gaps, ["host"]).collect()}
    assert set(merged) == {"a", "b"} and merged["a"].gaps == whole["a"].gaps == 24_000
    for host in ("a", "b"):
        values = sorted(g for _, h, g in rows if h == host and g is not None)
        for p, found in zip((0.25, 0.5, 0.75, 0.9), merged[host].thresholds, strict=True):
            low, high = bisect_left(values, found), bisect_right(values, found)
            assert low < high  # a gap that occurs
            off = max(low / len(values) - p, p - high / len(values), 0)
            assert off <= 2 / aggregates.SKETCH_ENTRIES + 1 / len(values)


def test_a_month_can_be_added_later(spark, tmp_path):
    _, gaps = gaps_of(spark, 3)
    path = str(tmp_path / "sketches")
    for month in range(3):
        sketch = aggregates.gap_sketches(gaps.where(F.col("month") == month), ["month", "host"])
        sketch.write.mode("append").parquet(path)
    stored = aggregates.merged_percentiles(spark.read.parquet(path), ["host"])
    exact = {r.host: r.thresholds for r in aggregates.agg_percentiles(gaps, ["host"]).collect()}
    for row in stored.collect():
        assert row.thresholds == pytest.approx(exact[row.host], rel=0.03, abs=1)
    assert aggregates.merged_percentiles(aggregates.gap_sketches(gaps.limit(0), ["month", "host"]), ["host"]).isEmpty()
