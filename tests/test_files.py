"""Files of the log tables: skipped row groups, compaction, result documents in one pass."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators.filters import filter_host, filter_memory_errors
from faultline.plans.collect import (
    collect_memory_errors,
    collect_typed_logs,
    collect_typed_memory_errors,
    typed_memory_errors,
)
from faultline.sinks import tables as sinks
from faultline.sinks.results import result_documents, sink_results_json
from faultline.sources import tables as sources
from faultline.sources.results import scan_results_json

ERROR = "x EDAC MC0: 1 CE memory read error on CPU#0 (slot:0)"


def log_rows(spark, count, share=100):
    """Typed logs of two days; one message in ``share`` is a memory error, some are NULL."""
    msg = F.when(F.col("id") % share == 3, ERROR).when(F.col("id") % 101 == 5, None).otherwise(
        F.concat(F.lit("session opened by "), F.sha2(F.col("id").cast("string"), 256))
    )
    rows = spark.range(count, numPartitions=4).select(
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit("6").alias("priority"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 172800).alias("timestamp"),
        F.concat(F.lit("c20"), F.pmod(F.xxhash64("id"), F.lit(30)).cast("string")).alias("host"),
        *[F.lit("0").alias(name) for name in ("partition", "Facility", "topic", "Severity")],
        msg.alias("msg"),
    )
    return rows.withColumns(
        {name: F.date_format("timestamp", form) for name, form in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))}
    )


def rows_scanned(table):
    """Rows that the scan gave to the plan, after row groups and pages were skipped."""
    table.collect()
    plan = table._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_row_groups_without_errors_are_not_read(spark, tmp_path):
    path, plain = str(tmp_path / "typed"), str(tmp_path / "plain")
    logs = log_rows(spark, 60_000)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(256 << 10))
    try:
        sinks.sink_typed_logs(logs, path)
        sinks.sink_typed_logs(logs, plain, mark_errors=False)
    finally:
        conf.unset("parquet.block.size")
    found = typed_memory_errors(spark, path, "20240101", "20240102")
    before = typed_memory_errors(spark, plain, "20240101", "20240102")
    assert found.count() == before.count() == 600
    assert found.exceptAll(before).isEmpty() and before.exceptAll(found).isEmpty()
    assert rows_scanned(before) == 60_000
    assert rows_scanned(found) < 30_000
    one = typed_memory_errors(spark, path, "20240101", "20240102", host="c207")
    assert 0 < one.count() < 60 and rows_scanned(one) <= rows_scanned(found)
    assert "memory_error" not in sources.scan_parquet_month(spark, path, 2024, 1).columns


def test_rows_from_before_the_mark_are_looked_at(spark, tmp_path):
    path = str(tmp_path / "typed")
    old, new = (log_rows(spark, 4000).where(F.col("day") == day) for day in ("01", "02"))
    sinks.sink_typed_logs(old, path, mark_errors=False)
    sinks.sink_typed_logs(new, path)
    table = spark.read.schema(schemas.MARKED_LOGS).parquet(path)
    assert table.where("memory_error is null").count() == old.count()
    expected = log_rows(spark, 4000).drop("headers")
    assert filter_memory_errors(table).count() == filter_memory_errors(expected).count() == 40


def test_collecting_from_typed_logs_gives_the_same_table(spark, tmp_path):
    raw, typed, one, two = (str(tmp_path / n) for n in ("raw", "typed", "one", "two"))
    headers = F.create_map(
        F.lit("timestamp"), F.unix_millis("timestamp").cast("string"), F.lit("host"), F.col("host"),
        F.lit("Severity"), F.lit("2"),
    )
    rows = log_rows(spark, 5000).select(headers.alias("headers"), F.encode("msg", "ISO-8859-1").alias("body"), *sinks.DAY)
    sinks.write_partitioned(rows, raw, sinks.DAY)
    collect_typed_logs(spark, raw, typed, "20240101", "20240102")
    collect_memory_errors(spark, raw, one, "20240101", "20240102")
    collect_typed_memory_errors(spark, typed, two, "20240101", "20240102")
    a, b = (spark.read.schema(schemas.MEMORY_ERRORS).parquet(p) for p in (one, two))
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def files(path):
    return sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))


def error_rows(spark, days, hosts, per_host):
    rows, rng = [], random.Random(5)
    for day in range(days):
        for host in range(hosts):
            for k in range(per_host * (20 if host == 0 else 1)):
                at = dt.datetime(2024, 1, 1 + day, rng.randrange(24), rng.randrange(60), rng.randrange(60))
                rows.append((at, f"{ERROR} {rng.random()}", f"c20{host}" if host else None, "2024", "01", f"{1 + day:02d}"))
    return spark.createDataFrame(rows, "timestamp timestamp, msg string, host string, year string, month string, day string")


def as_set(table):
    return sorted(map(str, table.select("timestamp", "msg", "host", "year", "month", "day").collect()))


def test_files_follow_bytes_not_hosts(spark, tmp_path):
    errors = error_rows(spark, 3, 40, 2)
    by_day, by_host = str(tmp_path / "day"), str(tmp_path / "host")
    sinks.sink_memory_errors(errors, by_day)
    sinks.sink_memory_errors(errors, by_host, by_host=True)
    assert len(files(by_day)) == 3 and len(files(by_host)) == 120
    for path in (by_day, by_host):
        assert as_set(spark.read.schema(schemas.MEMORY_ERRORS).parquet(path)) == as_set(errors)
    for path in files(by_day):
        hosts = [r.host for r in spark.read.parquet(path).select("host").collect()]
        assert hosts == sorted(hosts, key=lambda h: (h is not None, h))


def test_compaction(spark, tmp_path):
    """Days in many files are rewritten, others are left; run again, nothing is to do."""
    path = str(tmp_path / "errors")
    errors = error_rows(spark, 4, 25, 3)
    sinks.write_partitioned(errors.where("day != '04'").repartition(6), path, sinks.DAY)
    sinks.sink_memory_errors(errors.where("day = '04'"), path)
    kept = files(f"{path}/year=2024/month=01/day=04")
    assert len(files(path)) > 4
    assert sinks.compact_memory_errors(spark, path) == 3
    assert len(files(path)) == 4 and files(f"{path}/year=2024/month=01/day=04") == kept
    table = spark.read.schema(schemas.MEMORY_ERRORS).parquet(path)
    assert as_set(table) == as_set(errors)
    assert sinks.compact_memory_errors(spark, path) == 0
    hosts = filter_host(sources.scan_parquet_filtered(spark, path, 2024, 1), "c203")
    assert hosts.count() == 12


def test_a_table_by_host_is_converted_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "errors")
    errors = error_rows(spark, 3, 20, 1)
    sinks.sink_memory_errors(errors.where("day != '03'"), path, by_host=True)
    with pytest.raises(ValueError, match="layout"):
        sinks.sink_memory_errors(errors.where("day = '03'"), path)
    assert sinks.compact_memory_errors(spark, path) == 2
    sinks.sink_memory_errors(errors.where("day = '03'"), path)
    with pytest.raises(ValueError, match="layout"):
        sinks.sink_memory_errors(errors, path, by_host=True)
    assert len(files(path)) == 3
    assert as_set(spark.read.schema(schemas.MEMORY_ERRORS).parquet(path)) == as_set(errors)


def test_compaction_packs_hosts_and_splits_a_large_one(spark, tmp_path):
    path = str(tmp_path / "errors")
    errors = error_rows(spark, 1, 30, 200)
    sinks.sink_memory_errors(errors, path, by_host=True)
    sizes = {os.path.dirname(f): os.path.getsize(f) for f in files(path)}
    target = max(sizes.values()) // 4
    assert sinks.compact_memory_errors(spark, path, target) == 1
    after = [os.path.getsize(f) for f in files(path)]
    assert 4 < len(after) < len(sizes) and max(after) < 3 * target
    assert as_set(spark.read.schema(schemas.MEMORY_ERRORS).parquet(path)) == as_set(errors)


def test_compaction_of_nothing(spark, tmp_path):
    path = str(tmp_path / "errors")
    sinks.sink_memory_errors(error_rows(spark, 1, 2, 1), path)
    assert sinks.compact_memory_errors(spark, path) == 0


def test_result_documents_read_their_input_once(spark, tmp_path):
    source, path = str(tmp_path / "rows"), str(tmp_path / "results")
    rows = [
        (period, f"c{h:04d}" if h else None, f"percentil_{k}", 10, 5, h + k / 4)
        for period in ("202208", "202212") for h in range(230) for k in range(4)
    ]
    columns = "period string, host string, percentile string, count_before bigint, count_after bigint, mtbf_seconds double"
    spark.createDataFrame(rows, columns).write.parquet(source)
    results = spark.read.parquet(source)
    documents = result_documents(results, 100)
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert sorted((r.period, r.part) for r in documents.collect()) == [
        (period, part) for period in ("202212", "20228") for part in range(3)
    ]
    sink_results_json(results, path, 100)
    assert len(glob.glob(f"{path}/period=*/*.txt")) == 6
    sink_results_json(results.where("period = '202212' and host < 'c0050'"), path, 100)
    assert len(glob.glob(f"{path}/period=202212/*.txt")) == 1  # all old documents of the period go
    read = [tuple(r) for r in scan_results_json(spark, path).collect()]
    expected = [(p, h or "null", *rest) for p, h, *rest in rows if p == "202208" or (h and h < "c0050")]
    assert sorted(read) == sorted(expected)


def test_feature_files_without_a_column_are_refused(spark, tmp_path):
    path = str(tmp_path / "features")
    names = [n for n in schemas.FEATURES.names if n not in ("year", "month", "error_ratio")]
    row = spark.range(1).select(*[F.lit(None).cast(schemas.FEATURES[n].dataType).alias(n) for n in names])
    row = row.withColumn("year", F.lit("2024")).withColumn("month", F.lit("01"))
    sinks.sink_features_month(row, path)
    with pytest.raises(ValueError, match="error_ratio"):
        sources.scan_feature_dataset(spark, f"{path}/year=*/month=*", path)
