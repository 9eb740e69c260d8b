"""Log tables derived from the given test tables, for the registered queries.

Each derived table has a Spark form and a SQL form that give the same rows. Tables with
``shift`` 15 start on 16 January 2024, so they span two months.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.operators.filters import filter_host_prefixes, filter_memory_errors
from faultline.plans.collect import collect_memory_errors, collect_typed_logs
from faultline.plans.features import feature_dataset_periods
from faultline.plans.mtbf import mtbf
from faultline.session import shared_folder, require_settings
from faultline.sinks.results import sink_results_json
from faultline.sinks.tables import sink_features_month, write_partitioned
from faultline.sources.tables import scan_feature_dataset

# Read by Spark and by DuckDB; {events} is the events table.
LOGS = """
select event_id,
  date_trunc('second', ts) + interval '{shift}' day as timestamp,
  ts + interval '{shift}' day as exact_ts,
  case when user_id%50=49 then ' '
       else 'c2' || lpad(cast(user_id%20 as string),2,'0') || '-' || (user_id%3) end as host,
  cast(event_id%8 as int) as severity,
  case when event_type='error' then
         'kernel: EDAC sbridge MC' || (user_id%2) || ': ' || (1+event_id%3)
         || (case when event_id%5=0 then ' UE' else ' CE' end)
         || ' memory read error on CPU_SrcID#' || (user_id%2) || '_Ha#' || (event_id%2)
         || '_Chan#' || (event_id%4) || '_DIMM#' || (event_id%3)
         || ' (channel:' || (event_id%4) || ' slot:' || (event_id%3)
         || ' page:0x' || lower(hex(event_id))
         || ' offset:0x1c0 grain:32 syndrome:0x0 err_code:0x0101:0x009' || (event_id%3)
         || (case when event_id%4=0 then '' else
            ' SystemAddress:0x1' || lower(hex(event_id*64))
            || ' ProcessorSocketId:0x' || (user_id%2) || ' MemoryControllerId:0x' || (event_id%2)
            || ' ChannelAddress:0x2' || lower(hex(event_id*32)) || ' ChannelId:0x' || (event_id%4)
            || ' RankAddress:0x3' || lower(hex(event_id*16)) || ' PhysicalRankId:0x' || (event_id%5)
            || ' DimmSlotId:0x' || (event_id%3) || ' Row:0x' || lower(hex(event_id%4096))
            || ' Column:0x' || lower(hex(event_id%1024)) || ' Bank:0x' || (event_id%8)
            || ' BankGroup:0x' || (event_id%6) || ' ChipSelect:0x' || (event_id%7)
            || ' ChipId:0x' || (event_id%9) end) || ')'
       when event_type='signup' then 'kernel: EDAC sbridge HANDLING MCE MEMORY ERROR'
       else 'sshd session ' || event_type end as msg
from {events}
"""
DATED = """
select *, cast(year(timestamp) as string) as year,
  lpad(cast(month(timestamp) as string),2,'0') as month,
  lpad(cast(day(timestamp) as string),2,'0') as day
from {logs}
"""
# Shifts that together give December 2023, January 2024 and March 2024.
QUARTER = (-31, 0, 60)
Shift = int | tuple[int, ...]
# Months and years of logs, from the orders table. A made-up message marks the errors.
LONG_ERROR = "kernel: EDAC MC0: 1 CE memory read error on CPU_SrcID#0_Ha#0_Chan#1_DIMM#0 (slot:0)"

HOST_FILTER = f"({' or '.join(f"host like '{prefix}%'" for prefix in fixed.HOST_PREFIXES)})"
ERROR_FILTER = (
    f"upper(msg) like '{fixed.UPPER_MESSAGE_LIKE}' and lower(msg) like '{fixed.LOWER_MESSAGE_LIKE}'"
)
NOISE_FILTER = f"msg not like '{fixed.NOISE_MESSAGE_LIKE}'"
CLASS_PATTERN = fixed.ERROR_CLASS_PATTERN


# --- Spark forms ------------------------------------------------------------------
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    require_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_logs(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    events = read(spark, sf_dir, "events")
    rows = spark.sql(LOGS.replace("{shift}", str(shift)), events=events)
    rows = spark.sql(DATED, logs=rows)
    return rows.withColumns(
        {name: F.col(name).cast("timestamp") for name in ("timestamp", "exact_ts")}
    )


def logs(spark: SparkSession, sf_dir: str, shift: Shift = 0) -> DataFrame:
    """The derived logs, stored by day like a log table."""
    table = {0: log_table, 15: shifted_log_table, QUARTER: quarter_log_table}[shift]
    path = table(spark, sf_dir)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def errors(spark: SparkSession, sf_dir: str, shift: Shift = 0) -> DataFrame:
    return filter_memory_errors(filter_host_prefixes(logs(spark, sf_dir, shift)))


def raw_logs(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    header = {
        "priority": F.lit("6"),
        "timestamp": F.unix_millis("exact_ts").cast("string"),
        "host": F.col("host"),
        "partition": F.lit("0"),
        "Facility": F.lit("0"),
        "topic": F.lit("syslog"),
        "Severity": F.col("severity").cast("string"),
    }
    pairs = [column for name, value in header.items() for column in (F.lit(name), value)]
    return logs(spark, sf_dir, shift).select(
        F.create_map(*pairs).alias("headers"),
        F.encode("msg", "ISO-8859-1").alias("body"),
        "year",
        "month",
        "day",
    )


def typed(spark: SparkSession, sf_dir: str, shift: Shift = 0) -> DataFrame:
    """Typed logs as the feature job reads them."""
    return logs(spark, sf_dir, shift).select(
        "event_id",
        "timestamp",
        "host",
        F.col("severity").cast("string").alias("Severity"),
        "msg",
        "year",
        "month",
        "day",
    )


def logs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = orders.select(
        key.alias("event_id"),
        (
            F.col("o_orderdate").cast("timestamp")
            + F.make_dt_interval(secs=(key * 7919 % 86400).cast("decimal(18,6)"))
        ).alias("timestamp"),
        F.concat(F.lit("c2"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0")).alias("host"),
        (key % 8).cast("string").alias("Severity"),
        F.when(key % 5 == 0, LONG_ERROR).otherwise("session opened").alias("msg"),
    )
    return rows.withColumns(
        {
            "year": F.date_format("timestamp", "yyyy"),
            "month": F.date_format("timestamp", "MM"),
            "day": F.date_format("timestamp", "dd"),
        }
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.round(F.col("value") / 500, 3).alias("score"),
    )


# --- Tables on disk, written once per session and input ---------------------------
def once(write: Callable[[SparkSession, str, str], None]) -> Callable[[SparkSession, str], str]:
    @cache
    def path_for(application: str, sf_dir: str, spark: SparkSession) -> str:
        path = shared_folder(spark, write.__name__)
        write(spark, sf_dir, path)
        return path

    return lambda spark, sf_dir: path_for(spark.sparkContext.applicationId, sf_dir, spark)


LOG_SCHEMA = (
    "event_id bigint, timestamp timestamp, exact_ts timestamp, host string, severity int, "
    "msg string, year string, month string, day string"
)


def write_by_day(table: DataFrame, path: str) -> None:
    partitions = ["year", "month", "day"]
    write_partitioned(table.hint("rebalance", *partitions), path, partitions)


@once
def log_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    write_by_day(derived_logs(spark, sf_dir, 0), path)


@once
def shifted_log_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    write_by_day(derived_logs(spark, sf_dir, 15), path)


@once
def quarter_log_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    months = [derived_logs(spark, sf_dir, shift) for shift in QUARTER]
    write_by_day(months[0].unionByName(months[1]).unionByName(months[2]), path)


@once
def raw_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    write_by_day(raw_logs(spark, sf_dir, 15), path)


@once
def typed_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    collect_typed_logs(spark, raw_table(spark, sf_dir), path, "20240101", "20241231")


@once
def error_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    collect_memory_errors(spark, raw_table(spark, sf_dir), path, "20240101", "20241231")


@once
def feature_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = feature_dataset_periods(typed(spark, sf_dir, 15), (2024, 1), (2024, 2), [3600])
    sink_features_month(rows.drop("window_seconds"), path)


@once
def january_features(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = feature_dataset_periods(typed(spark, sf_dir), (2024, 1), (2024, 1), [3600])
    sink_features_month(rows.drop("window_seconds"), path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return scan_feature_dataset(spark, f"{path}/year=*/month=*", path)


@once
def result_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    sink_results_json(mtbf(errors(spark, sf_dir, 15)), path)


# --- SQL forms --------------------------------------------------------------------
def logs_sql(shift: Shift = 0) -> str:
    shifts = shift if isinstance(shift, tuple) else (shift,)
    return f"logs as ({' union all '.join(sql_of(LOGS, each) for each in shifts)})"


def sql_of(text: str, shift: int) -> str:
    inner = text.replace("{shift}", str(shift)).replace("{events}", "events")
    return DATED.replace("{logs}", f"({inner})")


def with_logs(query: str, shift: Shift = 0, **ctes: str) -> str:
    parts = [logs_sql(shift)] + [f"{name} as ({text})" for name, text in ctes.items()]
    return f"with {', '.join(parts)} {query}"


ERRORS_SQL = f"select * from logs where {HOST_FILTER} and {ERROR_FILTER}"
CLEAN_SQL = (
    f"select *, trim(regexp_extract(msg, '{fixed.ERROR_FIELD_PATTERNS['cpu_info']}', 1)) as cpu_info, "
    f"regexp_extract(msg, '{fixed.ERROR_FIELD_PATTERNS['err_code']}', 1) as err_code, "
    f"regexp_extract(regexp_extract(msg, '{fixed.ERROR_FIELD_PATTERNS['ce_error']}', 1), "
    f"'{fixed.CE_COUNT_PATTERN}', 1) as number_ce_error from errors where {NOISE_FILTER}"
)
FLAGGED_SQL = (
    "select event_id, case when host is null or trim(host)='' then 'UNKNOWN_HOST' else host end "
    "as host, timestamp, severity as \"Severity\", msg, "
    f"cast(regexp_extract(msg, '{CLASS_PATTERN}', 1) <> '' as int) as is_error, year, month "
    "from logs"
)
LONG_SQL = (
    "select o_orderkey as event_id, "
    "cast(o_orderdate as timestamp) + to_seconds(o_orderkey*7919%86400) as timestamp, "
    "'c2' || lpad(cast(o_custkey%20 as varchar),2,'0') as host, "
    "cast(o_orderkey%8 as int) as severity, "
    "case when o_orderkey%5=0 then 1 else 0 end as is_error from orders"
)
SCORED_SQL = (
    "select event_id, cast(event_type='error' as int) as label, round(value/500, 3) as score "
    "from events"
)


# --- Result columns ---------------------------------------------------------------
def comparable(result: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps without a time zone, as the SQL forms give them."""
    columns = []
    for field in result.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "double":
            column = F.round(column, digits)
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return result.select(*columns)
