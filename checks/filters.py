"""Filters, set operations, sorts and limits."""

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from faultline.operators import filters, sets, sorting

BASE = ("event_id", "timestamp", "host", "msg")
BASE_SQL = "event_id, timestamp, host, msg"


@query(
    t.with_logs(
        f"select {BASE_SQL} from logs where timestamp < timestamp '2024-02-01' or "
        "timestamp::date = date '2024-02-03'",
        15,
    )
)
def filter_partition_eq(spark, sf_dir):
    rows = t.logs(spark, sf_dir, 15)
    month = filters.filter_partition_eq(rows, 2024, 1)
    return month.unionByName(filters.filter_partition_eq(rows, 2024, 2, 3)).select(*BASE)


@query(t.with_logs(f"select {BASE_SQL} from logs where host = 'c205-1'"))
def filter_host(spark, sf_dir):
    return filters.filter_host(t.logs(spark, sf_dir), "c205-1").select(*BASE)


@query(t.with_logs(f"select {BASE_SQL} from logs where {t.HOST_FILTER}"))
def filter_host_prefixes(spark, sf_dir):
    return filters.filter_host_prefixes(t.logs(spark, sf_dir)).select(*BASE)


@query(t.with_logs(f"select {BASE_SQL} from logs where {t.ERROR_FILTER}"))
def filter_memory_errors(spark, sf_dir):
    return filters.filter_memory_errors(t.logs(spark, sf_dir)).select(*BASE)


@query(t.with_logs(f"select {BASE_SQL} from logs where {t.NOISE_FILTER}"))
def filter_exclude_noise(spark, sf_dir):
    return filters.filter_exclude_noise(t.logs(spark, sf_dir)).select(*BASE)


@query(
    "select event_id, nullif(event_type, 'error') as kind from events where event_type <> 'error'"
)
def filter_not_null(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("kind")
    )
    return filters.filter_not_null(rows, "kind")


@query(
    t.with_logs(
        f"select {BASE_SQL} from logs where timestamp >= timestamp '2024-01-08' and "
        "timestamp < timestamp '2024-01-22'"
    )
)
def filter_time_range(spark, sf_dir):
    limits = [F.lit(f"2024-01-{day}").cast("timestamp") for day in ("08", "22")]
    return filters.filter_time_range(t.logs(spark, sf_dir), "timestamp", *limits).select(*BASE)


@query(t.with_logs(f"select {BASE_SQL} from logs where host in ('c208-1', 'c211-0', 'c207-2')"))
def filter_in_list(spark, sf_dir):
    hosts = ["c208-1", "c211-0", "c207-2"]
    return filters.filter_in_list(t.logs(spark, sf_dir), "host", hosts).select(*BASE)


@query(f"select * from ({t.SCORED_SQL}) where label = 1")
def filter_class(spark, sf_dir):
    return filters.filter_class(t.scored(spark, sf_dir), "label", 1)


@query("select event_id, ts, event_type from events union all select event_id, ts, event_type from events")
def union_all_positional(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    renamed = rows.toDF("a", "b", "c")
    return sets.union_all_positional([rows, renamed])


@query(t.with_logs("select timestamp, host, msg from logs", 15))
def union_by_name(spark, sf_dir):
    rows = t.logs(spark, sf_dir, 15).select("timestamp", "host", "msg", "year", "month", "day")
    january = filters.filter_partition_eq(rows, 2024, 1).select("msg", "host", "timestamp", "day")
    return sets.union_by_name(filters.filter_partition_eq(rows, 2024, 2), january)


@query(t.with_logs(f"select {BASE_SQL} from logs order by timestamp, event_id"))
def sort_by(spark, sf_dir):
    return sorting.sort_by(t.logs(spark, sf_dir).select(*BASE), "timestamp", "event_id")


@query(
    t.with_logs(
        "select host, count(*) as rows from errors group by host having count(*) > 5",
        errors=t.ERRORS_SQL,
    )
)
def limit_threshold(spark, sf_dir):
    return sorting.limit_threshold(t.errors(spark, sf_dir), "host", 5)
