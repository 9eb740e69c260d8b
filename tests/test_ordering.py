import random

import pytest
from pyspark.sql import functions as F

from faultline.operators.ordering import burst_ids, first_rows, gap_seconds, number_rows
from faultline.plans.bursts import burst_table


def frame(spark, at, rows):
    return spark.createDataFrame(rows, "id bigint, key string, second bigint").select(
        "id", "key", at().alias("timestamp"), "second"
    )


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_number_rows(spark, at, keys):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["a", "a", "b", None]), rng.choice([0, 0, rng.randint(0, 300000)]))
        for i in range(400)
    ]
    numbered = number_rows(
        frame(spark, at, rows), keys, ["id"], spread=F.pmod("id", F.lit(4))
    ).withColumn("gap", gap_seconds("timestamp", "prev_timestamp"))
    ours = {r.id: (r.row_number, r.gap) for r in numbered.collect()}
    expected = {}
    for key in {k for _, k, _ in rows} if keys else {0}:
        part = sorted((s, i % 4, i) for i, k, s in rows if not keys or k == key)
        for place, (second, _, i) in enumerate(part):
            previous = part[place - 1][0] if place else None
            expected[i] = (place + 1, None if previous is None else second - previous)
    assert ours == expected


def test_number_rows_is_a_total_order_by_default(spark, at):
    rows = [(i, "a", i // 50) for i in range(200)]
    numbered = number_rows(frame(spark, at, rows), ["key"], ["id"])
    assert sorted(r.row_number for r in numbered.collect()) == list(range(1, 201))
    again = number_rows(frame(spark, at, rows).repartition(3), ["key"], ["id"])
    assert numbered.select("id", "row_number").exceptAll(again.select("id", "row_number")).isEmpty()


def test_copies_of_one_row_are_dealt_evenly(spark, at):
    """400,000 equal rows in one second, among others of that second and of other keys."""
    copies = spark.range(400_000, numPartitions=8).selectExpr("7L as id", "'a' as key", "1000L as second")
    others = [(i, name, 1000 + i % 4) for i, name in enumerate(["a", "b", None] * 40)]
    rows = copies.union(spark.createDataFrame(others, "id bigint, key string, second bigint"))
    rows = rows.withColumn("timestamp", at())
    numbered = number_rows(rows, ["key"], ["id"]).where("key = 'a'").cache()
    sizes = [
        r["count"] for r in numbered.where("id = 7 and second = 1000").groupBy(F.spark_partition_id()).count().collect()
    ]
    assert sum(sizes) == 400_000 and max(sizes) <= 2 * sum(sizes) / 8
    assert numbered.agg(F.min("row_number"), F.max("row_number"), F.count_distinct("row_number")).first()[:] == (
        1, 400_040, 400_040,
    )
    wrong = numbered.where(
        "case when row_number = 1 then prev_timestamp is not null else "
        "prev_timestamp is null or prev_timestamp > timestamp end"
    )
    assert wrong.isEmpty()
    gaps = numbered.where("prev_timestamp < timestamp").select("second").collect()
    assert sorted(r.second for r in gaps) == [1001, 1002, 1003]
    numbered.unpersist()


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_crowded_slots_give_the_same_numbers(spark, at, keys):
    """Both ways of ranking agree, whatever counts as crowded."""
    rng = random.Random(8)
    rows = [(rng.randint(0, 9), rng.choice(["a", "b", None]), rng.choice([0, 0, 60, None])) for _ in range(600)]
    table = frame(spark, at, rows).withColumn("headers", F.create_map(F.lit("h"), F.col("key")))
    plain = number_rows(table, keys, ["id", "key"])
    counted = number_rows(table, keys, ["id", "key"], crowded=2)
    names = ["id", "key", "second", "timestamp", "prev_timestamp", "row_number"]
    key = lambda row: str(tuple(row))
    assert sorted(plain.select(names).collect(), key=key) == sorted(counted.select(names).collect(), key=key)
    assert counted.columns == plain.columns


def test_burst_ids_share_a_timestamp(spark, at):
    rows = [(0, "a", 0), (1, "a", 10), (2, "a", 10), (3, "a", 12), (4, None, 99)]
    gaps = frame(spark, at, rows).withColumn(
        "time_diff_seconds", F.when(F.col("id") == 1, 10).otherwise(0)
    )
    ids = {r.id: r.group_id for r in burst_ids(gaps, ["key"], F.lit(10)).collect()}
    assert ids == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("count", [0, 1, 7, 10, 29, 30, 31])
def test_first_rows(spark, count):
    rows = [(b, h) for b in range(3) for h in range(10)]
    table = spark.createDataFrame(rows, "bucket int, host int").repartition(4)
    marked = first_rows(table, "bucket", ["host"], F.lit(count)).where("is_first").collect()
    assert sorted((r.bucket, r.host) for r in marked) == rows[:count]


def test_first_rows_share_of_total_and_null_order(spark):
    rows = [(0, None), (0, "a"), (0, "b"), (1, "a"), (1, "b")]
    table = spark.createDataFrame(rows, "bucket int, host string")
    marked = first_rows(table, "bucket", ["host"], F.col("total") * 0.5).where("is_first")
    assert {tuple(r) for r in marked.select("bucket", "host").collect()} == {(0, None), (0, "a")}


def naive_bursts(rows, threshold):
    """rows: (id, second, number or None) in any order."""
    rows = sorted(rows, key=lambda row: (row[1], row[0]))
    kept = [(b[1], b[1] - a[1], b[2]) for a, b in zip(rows, rows[1:])]
    result = {}
    for second, _, number in kept:
        group = sum(gap >= threshold for s, gap, _ in kept if s <= second)
        start, numbers, count = result.get(group, (second, [], 0))
        numbers = numbers + ([number] if number is not None else [])
        result[group] = (min(start, second), numbers, count + 1)
    return {g: (s, sum(n) if n else None, c) for g, (s, n, c) in result.items()}


def as_errors(spark, at, rows):
    msg = F.when(F.col("number").isNull(), "EDAC memory error").otherwise(
        F.concat(F.lit("EDAC "), F.col("number"), F.lit(" CE memory read error"))
    )
    return spark.createDataFrame(rows, "id bigint, second bigint, number int").select(
        "id", at().alias("timestamp"), msg.alias("msg")
    )


BURST_CASES = {
    "empty": [],
    "one row": [(0, 5, 1)],
    "tie in the first second": [(3, 5, 1), (1, 5, None), (2, 5, 4), (4, 7, None), (5, 90000, 2)],
    "first row alone": [(0, 0, 3), (1, 2, 1), (2, 7, 1), (3, 11, None), (4, 400000, 2)],
    "gap equal to threshold": [(i, s, 1) for i, s in enumerate((0, 5, 9, 14, 18, 24))],
    "over midnight": [(i, 86390 + 3 * i, 1) for i in range(9)],
    "same second only": [(i, 0, i) for i in range(6)],
}


@pytest.mark.parametrize("threshold", [0, 1, 5])
@pytest.mark.parametrize("name", BURST_CASES)
def test_burst_edges(spark, at, name, threshold):
    check_bursts(spark, at, BURST_CASES[name], threshold)


@pytest.mark.parametrize("seed", range(3))
def test_bursts_equal_naive(spark, at, seed):
    rng = random.Random(seed)
    times = [0]
    for _ in range(250):
        times.append(times[-1] + rng.choice([0, 0, 1, 3, 4, 5, 6, 4000, 100000]))
    rows = [(i, s, rng.choice([None, 1, 2, 3])) for i, s in enumerate(times)]
    check_bursts(spark, at, rows, 5)


def check_bursts(spark, at, rows, threshold):
    table = burst_table(as_errors(spark, at, rows).repartition(3), threshold, ["id"])
    ours = {
        r.group_id: (r.start, r.number_ce_error, r["count"])
        for r in table.withColumn("start", F.unix_seconds("min_timestamp")).collect()
    }
    assert ours == naive_bursts(rows, threshold)
