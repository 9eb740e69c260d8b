import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faultline import schemas
from faultline.plans.collect import collect_memory_errors, collect_typed_logs
from faultline.session import shared_folder
from faultline.sinks import tables as sinks
from faultline.sources import tables as sources

DAYS = [dt.date(2021, 12, 30) + dt.timedelta(days=i) for i in range(5)]
ERROR = "x EDAC MC0: 1 CE memory read error on CPU#0 (slot:0)"


@pytest.fixture(scope="module")
def raw_path(spark, tmp_path_factory):
    """Three records a day: an error, another message, an error of a host left out."""
    rows = []
    for day in DAYS:
        start = int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp())
        for offset, host, msg in ((60, "c205-1", ERROR), (7200, "login1", "hi"), (9000, "z", ERROR)):
            headers = {"timestamp": str((start + offset) * 1000 + 7), "host": host, "Severity": "2"}
            date = (f"{day.year}", f"{day.month:02d}", f"{day.day:02d}")
            rows.append((headers, bytearray(msg.encode("latin-1")), *date))
    path = str(tmp_path_factory.mktemp("raw") / "logs")
    raw = spark.createDataFrame(rows, schemas.RAW_LOGS)
    sinks.write_partitioned(raw, path, ["year", "month", "day"])
    return path


def dates(table):
    return sorted((r.year, r.month, r.day) for r in table.select("year", "month", "day").distinct().collect())


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


def formatted_plan_of(table):
    spark = table.sparkSession
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return table._jdf.queryExecution().explainString(mode)


def test_range_is_the_union_of_days_and_prunes(spark, raw_path):
    found = sources.scan_logs_range(spark, raw_path, "20211231", "20220102")
    assert dates(found) == [("2021", "12", "31"), ("2022", "01", "01"), ("2022", "01", "02")]
    assert found.count() == 9
    plan = formatted_plan_of(found)
    filters = next(t for t in plan.splitlines() if t.startswith("PartitionFilters"))
    assert "year" in filters and "make_date" in filters
    assert "PushedFilters" not in plan  # nothing is left for the rows
    assert sources.scan_logs_range(spark, raw_path, "20300101", "20300102").isEmpty()
    assert sources.scan_logs_range(spark, raw_path, "20220102", "20211231").isEmpty()


def test_range_of_a_table_name(spark, raw_path):
    spark.read.schema(schemas.RAW_LOGS).parquet(raw_path).createOrReplaceTempView("raw_view")
    assert sources.scan_logs_range(spark, "raw_view", "20211230", "20211230").count() == 3


def test_collect_jobs(spark, raw_path, tmp_path):
    typed, errors = str(tmp_path / "typed"), str(tmp_path / "errors")
    collect_typed_logs(spark, raw_path, typed, "20211230", "20220103")
    table = spark.read.schema(schemas.TYPED_LOGS).parquet(typed)
    assert table.count() == 15 and table.where("msg is null or timestamp is null").isEmpty()
    january = sources.scan_parquet_month(spark, typed, 2022, 1)
    assert january.count() == 9 and not {"year", "month", "day"} & set(january.columns)

    collect_memory_errors(spark, raw_path, errors, "20211230", "20220103")
    found = sources.scan_parquet_filtered(spark, errors)
    assert {r.host for r in found.collect()} == {"c205-1"} and found.count() == 5
    assert sources.scan_parquet_filtered(spark, errors, 2021, 12).count() == 2
    only = str(tmp_path / "only")
    collect_memory_errors(spark, raw_path, only, "20211230", "20220103", host="login1")
    assert not (tmp_path / "only" / "year=2021").exists()


def test_a_second_run_keeps_other_days(spark, raw_path, tmp_path):
    path = str(tmp_path / "typed")
    collect_typed_logs(spark, raw_path, path, "20211230", "20211231")
    collect_typed_logs(spark, raw_path, path, "20211231", "20220101")
    table = spark.read.schema(schemas.TYPED_LOGS).parquet(path)
    assert table.count() == 9 and len(dates(table)) == 3


@pytest.mark.parametrize("seconds,rows", [(60, 2), (55 * 60, 2), (61 * 60, 3), (2 * 86400, 7)])
def test_lookahead(spark, raw_path, tmp_path, seconds, rows):
    """Two error-free days of December, and what follows within the window and an hour."""
    path = str(tmp_path / "typed")
    collect_typed_logs(spark, raw_path, path, "20211230", "20220103")
    found = sources.scan_with_lookahead(spark, path, 2021, 12, seconds)
    end = int(dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc).timestamp()) + seconds + 3600
    all_rows = spark.read.schema(schemas.TYPED_LOGS).parquet(path)
    expected = all_rows.where((F.unix_seconds("timestamp") < end)).count()
    assert found.count() == expected
    assert sources.scan_with_lookahead(spark, path, 2022, 1, seconds).count() == 9


def test_optional_and_empty(spark, raw_path, tmp_path):
    assert sources.scan_optional(spark, str(tmp_path / "nothing")) is None
    assert sources.scan_optional(spark, raw_path).count() == 15
    (tmp_path / "bad").mkdir()
    with pytest.raises(AnalysisException):  # exists, but holds no table
        sources.scan_optional(spark, str(tmp_path / "bad"))
    empty = sources.scan_empty_like(spark.read.parquet(raw_path))
    assert empty.isEmpty() and empty.schema == spark.read.parquet(raw_path).schema


def test_file_counts(spark, raw_path, tmp_path):
    table = spark.read.schema(schemas.RAW_LOGS).parquet(raw_path).drop("headers", "body")
    january = table.where("month = '01'").withColumn("host", F.lit("a"))
    sinks.sink_features_month(january, str(tmp_path / "f"), files=2)
    files = list((tmp_path / "f" / "year=2022" / "month=01").glob("*.parquet"))
    assert len(files) == 2
    sinks.sink_typed_logs(table.withColumn("host", F.lit("a")), str(tmp_path / "t"), tasks=1)
    assert len(list((tmp_path / "t").glob("*/*/*/*.parquet"))) == 5


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one.startswith(root) and one != two


def test_stored_timestamps_have_statistics(spark, raw_path, tmp_path):
    path = str(tmp_path / "typed")
    collect_typed_logs(spark, raw_path, path, "20211230", "20220103")
    early = spark.read.schema(schemas.TYPED_LOGS).parquet(path).where("timestamp < '2022-01-01'")
    assert "LessThan(timestamp" in plan_of(early)
    import pyarrow.parquet as pq

    file = next((tmp_path / "typed").glob("*/*/*/*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    names = [group.column(i).path_in_schema for i in range(group.num_columns)]
    assert group.column(names.index("timestamp")).statistics.has_min_max
