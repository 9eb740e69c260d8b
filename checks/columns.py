"""Column functions over whole tables."""

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from faultline import fixed_values as fixed
from faultline.functions import calendars, parse, times
from faultline.operators import columns as ops

HEADERS_SQL = (
    "'6' as priority, cast(epoch_us(exact_ts) // 1000 as varchar) as timestamp, host, '0' as partition, "
    "'0' as \"Facility\", 'syslog' as topic, cast(severity as varchar) as \"Severity\""
)


def one(path: str) -> str:
    return path.replace("'", "''")


FIELDS_SQL = ", ".join(
    (f"trim(regexp_extract(msg, '{one(p)}', 1))" if name == "cpu_info"
     else f"regexp_extract(msg, '{one(p)}', 1)") + f' as "{name}"'
    for name, p in fixed.ERROR_FIELD_PATTERNS.items()
)
CLASS_SQL = f"regexp_extract(msg, '{t.CLASS_PATTERN}', 1)"


@query(t.with_logs(f"select {HEADERS_SQL} from logs"))
def headers_to_columns(spark, sf_dir):
    return t.raw_logs(spark, sf_dir).select(*parse.headers_to_columns())


@query(
    t.with_logs(
        "select cast(epoch_us(exact_ts) // 1000 as varchar) as epoch_ms, timestamp as at from logs"
    )
)
def epoch_ms_to_ts(spark, sf_dir):
    text = F.col("headers")["timestamp"]
    raw = t.raw_logs(spark, sf_dir)
    return raw.select(text.alias("epoch_ms"), parse.epoch_ms_to_ts(text).alias("at"))


@query("select doc_id, text from documents")
def decode_body(spark, sf_dir):
    bodies = t.read(spark, sf_dir, "documents").select(
        "doc_id", F.encode("text", "ISO-8859-1").alias("body")
    )
    return bodies.select("doc_id", parse.decode_body(F.col("body")).alias("text"))


@query(
    t.with_logs(
        f"select {HEADERS_SQL.replace('cast(epoch_us(exact_ts) // 1000 as varchar) as timestamp', 'timestamp')}, "
        "msg, year, month, day from logs"
    )
)
def normalize_logs(spark, sf_dir):
    return parse.normalize_logs(t.raw_logs(spark, sf_dir)).drop("headers")


@query(
    t.with_logs(
        f"select event_id, msg, {FIELDS_SQL}, regexp_extract(regexp_extract(msg, "
        f"'{one(fixed.ERROR_FIELD_PATTERNS['ce_error'])}', 1), '(\\d+)', 1) as number_ce_error "
        "from logs"
    )
)
def extract_error_fields(spark, sf_dir):
    return parse.extract_error_fields(t.logs(spark, sf_dir).select("event_id", "msg"))


@query(t.with_logs(f"select event_id, {CLASS_SQL} as error_class from logs"))
def classify_error(spark, sf_dir):
    error_class = parse.classify_error(F.col("msg")).alias("error_class")
    return t.logs(spark, sf_dir).select("event_id", error_class)


@query(
    t.with_logs(
        "select event_id, "
        + ", ".join(
            f"regexp_extract(msg, '{t.CLASS_PATTERN}', {group}) as {name}"
            for group, name in enumerate(("socket", "controller", "channel", "dimm"), start=2)
        )
        + " from logs"
    )
)
def parse_dimm_locator(spark, sf_dir):
    return t.logs(spark, sf_dir).select("event_id", *parse.parse_dimm_locator(F.col("msg")))


@query(t.with_logs(f"select event_id, cast({CLASS_SQL} <> '' as int) as is_error from logs"))
def error_flag(spark, sf_dir):
    flag = parse.error_flag(parse.classify_error(F.col("msg")))
    return t.logs(spark, sf_dir).select("event_id", flag.alias("is_error"))


@query(
    t.with_logs(
        "select event_id, epoch(time_bucket(interval 45 minute, timestamp, "
        "timestamp '1970-01-01'))::bigint as short, epoch(date_trunc('hour', timestamp))::bigint "
        "as long from logs"
    )
)
def parse_window_size(spark, sf_dir):
    sizes = {"short": "45 minutes", "long": " 1 hour"}
    buckets = [
        times.bucket_seconds("timestamp", times.parse_window_size(text)).alias(name)
        for name, text in sizes.items()
    ]
    return t.logs(spark, sf_dir).select("event_id", *buckets)


@query(t.with_logs("select event_id, severity from logs"))
def severity_int(spark, sf_dir):
    severity = parse.severity_int(F.col("Severity")).alias("severity")
    return t.typed(spark, sf_dir).select("event_id", severity)


@query(
    t.with_logs(
        "select event_id, case when trim(host) = '' then 'UNKNOWN_HOST' else host end as host "
        "from logs"
    )
)
def host_or_unknown(spark, sf_dir):
    host = parse.host_or_unknown(F.col("host")).alias("host")
    return t.logs(spark, sf_dir).select("event_id", host)


@query(
    "select o_orderkey, date_trunc('month', o_orderdate)::timestamp as month_start, "
    "(date_trunc('month', o_orderdate) + interval 1 month)::timestamp as month_end, "
    "year(date_trunc('month', o_orderdate) + interval 1 month)::int as next_year, "
    "month(date_trunc('month', o_orderdate) + interval 1 month)::int as next_month from orders"
)
def month_bounds(spark, sf_dir):
    date = F.col("o_orderdate")
    bounds = times.month_bounds(F.year(date), F.month(date))
    return t.read(spark, sf_dir, "orders").select("o_orderkey", *bounds)


def bucket_sql(seconds: int) -> str:
    return f"make_timestamp((epoch(timestamp)::bigint // {seconds} * {seconds}) * 1000000)"


@query(
    t.with_logs(
        "select event_id, "
        + ", ".join(f"{bucket_sql(size)} as start_{size}" for size in (300, 1800, 3600, 10800))
        + " from logs"
    )
)
def time_bucket(spark, sf_dir):
    rows = t.logs(spark, sf_dir)
    for size in (300, 1800, 3600, 10800):
        rows = rows.withColumn(f"start_{size}", times.time_bucket("timestamp", size))
    return rows.select("event_id", *[f"start_{size}" for size in (300, 1800, 3600, 10800)])


@query(
    t.with_logs(
        "select event_id, timestamp - interval 1800 second as earlier, "
        "timestamp + interval 5400 second as later from logs"
    )
)
def shift_interval(spark, sf_dir):
    at = F.col("timestamp")
    return t.logs(spark, sf_dir).select(
        "event_id",
        times.shift_seconds(at, -1800).alias("earlier"),
        times.shift_seconds(at, 5400).alias("later"),
    )


FEATURE_COUNTS_SQL = (
    "select host, count(*) as num_logs, sum(is_error)::bigint as num_errors from flagged "
    "group by host"
)


def feature_counts(spark, sf_dir):
    from faultline.plans.features import flag_logs

    flagged = flag_logs(t.typed(spark, sf_dir))
    return flagged.groupBy("host").agg(
        F.count(F.lit(1)).alias("num_logs"), F.sum("is_error").alias("num_errors")
    )


@query(
    t.with_logs(
        "select host, round(num_errors / num_logs, 6) as error_ratio "
        f"from ({FEATURE_COUNTS_SQL})",
        flagged=t.FLAGGED_SQL,
    )
)
def error_ratio(spark, sf_dir):
    ratio = ops.error_ratio(F.col("num_errors"), F.col("num_logs")).alias("error_ratio")
    return feature_counts(spark, sf_dir).select("host", ratio)


@query(
    "select c_custkey, coalesce(n, 0)::bigint as orders, coalesce(s, 'none') as statuses from "
    "customer left join (select o_custkey, count(*) as n, max(o_orderstatus) as s from orders "
    "group by o_custkey) on c_custkey = o_custkey"
)
def fill_defaults(spark, sf_dir):
    customers = t.read(spark, sf_dir, "customer").select("c_custkey")
    orders = t.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("statuses")
    )
    joined = customers.join(orders, "c_custkey", "left")
    return ops.fill_defaults(joined, {"orders": 0, "statuses": "none"})


@query("select event_id, ts, user_id, event_type from events")
def drop_if_present(spark, sf_dir):
    return ops.drop_if_present(t.read(spark, sf_dir, "events"), "value", "props", "no_such_column")


@query(
    t.with_logs(
        "select event_id, round(gap / 60, 2) as minutes_rounded, "
        "round(gap / 60, 6) as minutes, round(gap / 3600, 6) as hours from (select event_id, "
        "(epoch(timestamp) - epoch(timestamp '2024-01-01'))::bigint as gap from logs)"
    )
)
def gap_units(spark, sf_dir):
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    gap = F.unix_seconds("timestamp") - start
    return t.logs(spark, sf_dir).select(
        "event_id",
        times.gap_minutes(gap).alias("minutes_rounded"),
        times.seconds_to_minutes(gap).alias("minutes"),
        times.seconds_to_hours(gap).alias("hours"),
    )


@query(
    f"with logs_long as ({t.LONG_SQL}) select event_id, hour(timestamp)::int as hour, "
    "(dayofweek(timestamp) + 1)::int as day_of_week, strftime(timestamp, '%a') as day_name, "
    "day(timestamp)::int as day_of_month, month(timestamp)::int as month_number, "
    "strftime(timestamp, '%B') as month_name, timestamp::date as date from logs_long"
)
def calendar_columns(spark, sf_dir):
    columns = calendars.calendar_columns(F.col("timestamp"))
    return t.logs_long(spark, sf_dir).select("event_id", *columns)


@query(
    f"with logs_long as ({t.LONG_SQL}) select event_id, case when dayofweek(timestamp) between 1 "
    "and 5 then 'Semana' else 'Fin de semana' end as day_type from logs_long"
)
def day_type(spark, sf_dir):
    kind = calendars.day_type(F.col("timestamp")).alias("day_type")
    return t.logs_long(spark, sf_dir).select("event_id", kind)


@query(
    f"with logs_long as ({t.LONG_SQL}) select event_id, case when day(timestamp) <= 10 then "
    "'Inicio' when day(timestamp) <= 20 then 'Mitad' else 'Final' end as month_third "
    "from logs_long"
)
def month_third(spark, sf_dir):
    third = calendars.month_third(F.col("timestamp")).alias("month_third")
    return t.logs_long(spark, sf_dir).select("event_id", third)


@query(
    "select event_id, case event_id % 6 when 0 then '25%' when 1 then '50%' when 2 then '75%' "
    "when 3 then '90%' when 4 then 'N/A' end as label from events"
)
def percentile_label(spark, sf_dir):
    keys = [*fixed.PERCENTILE_KEYS, fixed.SPARSE_KEY, "unknown"]
    key = F.element_at(
        F.array(*[F.lit(name) for name in keys]), (F.col("event_id") % 6 + 1).cast("int")
    )
    label = calendars.percentile_label(key).alias("label")
    return t.read(spark, sf_dir, "events").select("event_id", label)


@query(
    "select o_orderkey, date_trunc('month', o_orderdate)::date as padded, "
    "date_trunc('month', o_orderdate)::date as unpadded, "
    "strftime(o_orderdate, '%Y%m') as period from orders"
)
def parse_period(spark, sf_dir):
    date = F.col("o_orderdate")
    unpadded = F.concat(F.year(date), F.month(date))
    return t.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        times.parse_period(F.date_format(date, "yyyyMM")).alias("padded"),
        times.parse_period(unpadded).alias("unpadded"),
        times.format_period(date).alias("period"),
    )


TIME_FEATURES_SQL = (
    "hour({0})::int as hour, (isodow({0}) - 1)::int as dayofweek, "
    "(hour({0}) <= 6 or hour({0}) >= 22)::int as is_night, (isodow({0}) >= 6)::int as is_weekend"
)


@query(f"with logs_long as ({t.LONG_SQL}) select event_id, {TIME_FEATURES_SQL.format('timestamp')} from logs_long")
def time_features(spark, sf_dir):
    columns = calendars.time_features(F.col("timestamp"))
    return t.logs_long(spark, sf_dir).select("event_id", *columns)


@query(
    t.with_logs(
        "select host, round(num_logs / (avg(num_logs) over () + 1e-6), 6) as log_intensity "
        f"from ({FEATURE_COUNTS_SQL})",
        flagged=t.FLAGGED_SQL,
    )
)
def log_intensity(spark, sf_dir):
    return ops.log_intensity(feature_counts(spark, sf_dir)).select("host", "log_intensity")
