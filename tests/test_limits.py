"""Time zones, NULL times, overflow and the life of stored tables."""

import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.times import bucket_seconds, parse_window_size, time_bucket
from faultline.operators.aggregates import agg_bursts
from faultline.operators.evaluation import eval_roc_auc, eval_threshold_curve
from faultline.operators.ordering import number_rows
from faultline.plans.bursts import burst_table
from faultline.plans.features import feature_dataset
from faultline.plans.learning import ml_prepare
from faultline.session import require_utc, work_tables
from faultline.sinks import tables as sinks
from faultline.sources import tables as sources


@pytest.fixture
def zone():
    before = os.environ.get("TZ")

    def set_zone(name):
        os.environ["TZ"] = name
        time.tzset()

    yield set_zone
    if before is None:
        os.environ.pop("TZ", None)
    else:
        os.environ["TZ"] = before
    time.tzset()


@pytest.fixture(scope="module")
def july(spark, tmp_path_factory):
    """One log before the end of July 2024 and one error half an hour after it."""
    path = str(tmp_path_factory.mktemp("typed") / "logs")
    error = "EDAC 1 CE memory read error on CPU_SrcID#0_Ha#0_Chan#1_DIMM#0 (slot:0)"
    rows = spark.sql(
        "select map('a', 'b') as headers, '6' as priority, 'c201' as host, '0' as partition, '0' as Facility, "
        "'t' as topic, '3' as Severity, timestamp_seconds(s) as timestamp, m as msg, '2024' as year, "
        f"mo as month, d as day from values (1722468600, 'fine', '07', '31'), (1722472200, '{error}', '08', '01'), "
        "(1722477600, 'late', '08', '01') as v(s, m, mo, d)"
    )
    sinks.write_partitioned(rows.select(*schemas.TYPED_LOGS.names), path, ["year", "month", "day"])
    return path


@pytest.mark.parametrize("name", ["UTC", "Europe/Madrid", "Asia/Tokyo", "America/New_York"])
def test_lookahead_in_any_zone_of_the_machine(spark, july, zone, name):
    zone(name)
    rows = sources.scan_with_lookahead(spark, july, 2024, 7, 3600)
    assert rows.count() == 2
    logs = spark.read.schema(schemas.TYPED_LOGS).parquet(july)
    labels = [r.label_next_hour for r in feature_dataset(logs, 2024, 7, 3600).collect()]
    assert labels == [1]


def test_other_session_zones_are_errors(spark, july):
    logs = spark.read.schema(schemas.TYPED_LOGS).parquet(july)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for job in (lambda: feature_dataset(logs, 2024, 7, 3600), lambda: ml_prepare(logs)):
            with pytest.raises(ValueError, match="UTC"):
                job()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    require_utc(spark)


def test_missing_column_is_an_error(spark, july, tmp_path):
    path = str(tmp_path / "less")
    spark.read.parquet(july).drop("msg").write.parquet(path)
    with pytest.raises(ValueError, match="no column msg"):
        sources.scan_parquet_month(spark, path, 2024, 7)


def test_buckets_keep_rows_without_a_time(spark, at):
    rows = spark.createDataFrame([(0,), (3700,), (-1,), (None,)], "second bigint")
    rows = rows.withColumn("timestamp", at())
    found = rows.select(
        "second",
        F.unix_seconds(time_bucket("timestamp", 3600)).alias("hour"),
        bucket_seconds("timestamp", 300).alias("five"),
    ).collect()
    assert {tuple(r) for r in found} == {(0, 0, 0), (3700, 3600, 3600), (-1, -3600, -300), (None, None, None)}


@pytest.mark.parametrize("text", ["0 hours", "-1 hour", "1.5 hours", "1", "hour", "1 hourly", "5 days", ""])
def test_window_sizes_are_checked(text):
    with pytest.raises(ValueError):
        parse_window_size(text)


def test_window_sizes():
    sizes = {"30 minutes": 1800, "1 minute": 60, "05 min": 300, "2 hours": 7200, " 1 hour ": 3600}
    assert {text: parse_window_size(text) for text in sizes} == sizes


def test_rows_without_a_time_are_numbered_first(spark, at):
    rows = spark.createDataFrame([(i, None if i < 2 else i * 1000) for i in range(6)], "id bigint, second bigint")
    rows = rows.select("id", at().alias("timestamp"), F.lit("k").alias("key"))
    found = {r.id: (r.row_number, r.prev_timestamp) for r in number_rows(rows, ["key"], ["id"]).collect()}
    assert sorted(n for n, _ in found.values()) == [1, 2, 3, 4, 5, 6]
    assert {found[0][0], found[1][0]} == {1, 2} and found[2] == (3, None)
    assert found[3][1] is not None


def test_crowded_second_of_like_rows_is_split(spark, at):
    rows = spark.range(200_000).select(
        F.lit(5).alias("second"), F.lit("h").alias("key"), F.lit("m").alias("msg"), "id"
    ).withColumn("timestamp", at())
    numbered = number_rows(rows, ["key"], ["msg"])
    sizes = [r[1] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 80_000


def test_error_numbers_beyond_an_int(spark, at):
    number = 2_000_000_000
    message = f"EDAC {number * 3} CE memory read error on CPU#0 (slot:0)"
    rows = spark.createDataFrame([(i, i) for i in range(5)], "host bigint, second bigint")
    errors = rows.select(F.col("host").cast("string"), at().alias("timestamp"), F.lit(message).alias("msg"))
    row = burst_table(errors).first()
    assert (row.number_ce_error, row["count"]) == (4 * 3 * number, 4)
    grouped = spark.range(4).select(
        F.lit(0).alias("g"), F.timestamp_seconds("id").alias("timestamp"), F.lit("1").alias("err_code"),
        F.lit(str(number)).alias("number_ce_error"),
    )
    assert agg_bursts(grouped, ["g"]).first().number_ce_error == 4 * number


def files_read(table):
    """Scans in a plan that has run."""
    table.collect()
    return table._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_messages_and_scores_are_read_once(spark, at, tmp_path):
    path = str(tmp_path / "scores")
    spark.range(100).selectExpr("id % 2 as label", "id / 50 - 0.5 as score").write.parquet(path)
    scored = spark.read.parquet(path)
    curve = eval_threshold_curve(scored)
    assert files_read(curve) <= 2 and curve.count() == 101  # the final plan shows a scan twice at most
    assert "subquery" not in curve._jdf.queryExecution().optimizedPlan().toString().lower()
    top = curve.orderBy("threshold").first()
    assert top.recall == pytest.approx(scored.where("label = 1 and score >= 0").count() / 50, abs=1e-6)

    rows = spark.createDataFrame([(i, i) for i in range(5)], "host bigint, second bigint")
    source = str(tmp_path / "errors")
    message = F.lit("EDAC 1 CE memory read error on CPU#0 (slot:0)").alias("msg")
    rows.select(F.col("host").cast("string"), at().alias("timestamp"), message).write.parquet(source)
    table = burst_table(spark.read.parquet(source))
    assert source not in "".join(table.inputFiles())


def test_stored_tables_go_with_their_scope(spark, at):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/faultline/*"))
    rows = spark.range(50).selectExpr("id % 2 as label", "id / 50 as score")
    with work_tables(spark):
        assert 0 <= eval_roc_auc(rows).first()[0] <= 1
        assert set(glob.glob(f"{root}/faultline/*")) - before
    assert set(glob.glob(f"{root}/faultline/*")) == before
