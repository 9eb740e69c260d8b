"""Sources and sinks: tables are written, read back and compared with the input."""

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from faultline.functions.parse import decode_body
from faultline.plans.collect import typed_memory_errors
from faultline.plans.features import feature_dataset
from faultline.plans.mtbf import mtbf
from faultline.schemas import FEATURES, MEMORY_ERRORS, TYPED_LOGS
from faultline.session import shared_folder
from faultline.sinks import results as result_sinks
from faultline.sinks import tables as sinks
from faultline.sources import results as result_sources
from faultline.sources import tables as sources
from checks.jobs import FEATURES_SQL, MTBF_CTES, MTBF_SQL

RAW_COLUMNS = (
    "cast(epoch_us(exact_ts) // 1000 as varchar) as epoch_ms, host, cast(severity as varchar) as severity, "
    "msg, year, month, day"
)


def raw_columns(raw):
    headers = F.col("headers")
    return raw.select(
        headers["timestamp"].alias("epoch_ms"),
        headers["host"].alias("host"),
        headers["Severity"].alias("severity"),
        decode_body(F.col("body")).alias("msg"),
        "year",
        "month",
        "day",
    )


@query(
    t.with_logs(
        f"select {RAW_COLUMNS} from logs where timestamp >= timestamp '2024-01-20' "
        "and timestamp < timestamp '2024-02-06'",
        15,
    )
)
def scan_logs_range(spark, sf_dir):
    """The range leaves out days on both sides."""
    return raw_columns(sources.scan_logs_range(spark, t.raw_table(spark, sf_dir), "20240120", "20240205"))


@query(t.with_logs("select timestamp, host, msg from logs where false"))
def scan_empty_like(spark, sf_dir):
    return sources.scan_empty_like(t.logs(spark, sf_dir).select("timestamp", "host", "msg"))


@query(
    t.with_logs(
        "select timestamp, host, cast(severity as varchar) as \"Severity\", msg from logs "
        "where timestamp < timestamp '2024-02-01'",
        15,
    )
)
def scan_parquet_month(spark, sf_dir):
    month = sources.scan_parquet_month(spark, t.typed_table(spark, sf_dir), 2024, 1)
    return month.select("timestamp", "host", "Severity", "msg")


@query(t.with_logs("select timestamp, host, msg from logs", 15))
def scan_optional(spark, sf_dir):
    path = t.typed_table(spark, sf_dir)
    assert sources.scan_optional(spark, f"{path}/no-such-folder", TYPED_LOGS) is None
    return sources.scan_optional(spark, path, TYPED_LOGS).select("timestamp", "host", "msg")


@query(
    t.with_logs(
        "select timestamp, host, msg from logs "
        "where timestamp < timestamp '2024-02-01' + interval 14400 second",
        15,
    )
)
def scan_with_lookahead(spark, sf_dir):
    rows = sources.scan_with_lookahead(spark, t.typed_table(spark, sf_dir), 2024, 1, 10800)
    return rows.select("timestamp", "host", "msg")


@query(
    t.with_logs(
        f"select timestamp, host, msg from errors where {t.NOISE_FILTER}", 15, errors=t.ERRORS_SQL
    )
)
def scan_parquet_filtered(spark, sf_dir):
    path = t.error_table(spark, sf_dir)
    months = [sources.scan_parquet_filtered(spark, path, 2024, month) for month in (1, 2)]
    return months[0].unionByName(months[1]).select("timestamp", "host", "msg")


@query(
    t.with_logs(
        f"select period, host, percentile, count_before, count_after, mtbf_seconds from ({MTBF_SQL})",
        15,
        **MTBF_CTES,
    )
)
def scan_results_json(spark, sf_dir):
    return result_sources.scan_results_json(spark, t.result_table(spark, sf_dir))


@query(
    t.with_logs(
        f"select *, strftime(feature_window_start, '%Y') as year, "
        f"strftime(feature_window_start, '%m') as month from ({FEATURES_SQL.format(window=3600)})",
        15,
        flagged=t.FLAGGED_SQL,
    )
)
def scan_feature_dataset(spark, sf_dir):
    path = t.feature_table(spark, sf_dir)
    return sources.scan_feature_dataset(spark, f"{path}/year=*/month=*", path)


@query(
    t.with_logs("select timestamp, host, msg, year, month, day from errors", errors=t.ERRORS_SQL)
)
def sink_memory_errors(spark, sf_dir):
    path = shared_folder(spark, "memory-errors")
    sinks.sink_memory_errors(t.errors(spark, sf_dir), path)
    return spark.read.schema(MEMORY_ERRORS).parquet(path)


@query(
    t.with_logs("select timestamp, host, msg, year, month, day from errors", errors=t.ERRORS_SQL)
)
def compact_memory_errors(spark, sf_dir):
    """Days in many small files, rewritten to files by size."""
    path = shared_folder(spark, "compacted-errors")
    sinks.write_partitioned(t.errors(spark, sf_dir).select("timestamp", "msg", "host", *sinks.DAY).repartition(8), path, sinks.DAY)
    sinks.compact_memory_errors(spark, path)
    return spark.read.schema(MEMORY_ERRORS).parquet(path)


@query(t.with_logs("select timestamp, host, msg, year, month, day from errors", 15, errors=t.ERRORS_SQL))
def filter_memory_errors_marked(spark, sf_dir):
    """Memory errors of typed logs by their mark, so that other row groups are not read."""
    path = t.typed_table(spark, sf_dir)
    return typed_memory_errors(spark, path, "20240101", "20241231")


@query(
    t.with_logs(
        "select timestamp, host, cast(severity as varchar) as \"Severity\", msg, year, month, day "
        "from logs"
    )
)
def sink_typed_logs(spark, sf_dir):
    path = shared_folder(spark, "typed-logs")
    sinks.sink_typed_logs(t.typed(spark, sf_dir), path)
    columns = ["timestamp", "host", "Severity", "msg", "year", "month", "day"]
    return spark.read.schema(TYPED_LOGS).parquet(path).select(*columns)


@query(
    t.with_logs(
        f"select *, '2024' as year, '01' as month from ({FEATURES_SQL.format(window=1800)})",
        flagged=t.FLAGGED_SQL,
    )
)
def sink_features_month(spark, sf_dir):
    path = shared_folder(spark, "features")
    sinks.sink_features_month(feature_dataset(t.typed(spark, sf_dir), 2024, 1, 1800), path)
    return spark.read.schema(FEATURES).parquet(path)


@query(
    t.with_logs(
        f"select period, host, percentile, count_before, count_after, mtbf_seconds from ({MTBF_SQL})",
        **MTBF_CTES,
    )
)
def sink_results_json(spark, sf_dir):
    path = shared_folder(spark, "results")
    result_sinks.sink_results_json(mtbf(t.errors(spark, sf_dir)), path)
    return result_sources.scan_results_json(spark, path)


@query(
    t.with_logs(
        "select host, count(*) as errors from errors group by host", errors=t.ERRORS_SQL
    )
)
def sink_to_driver(spark, sf_dir):
    """A report goes to the driver whole, and from there back to Spark."""
    report = t.errors(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("errors"))
    return spark.createDataFrame(result_sinks.sink_to_driver(report), report.schema)
