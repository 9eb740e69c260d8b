"""Aggregations, joins, time windows and whole jobs on logs."""

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from faultline import fixed_values as fixed
from faultline.functions.parse import error_field, extract_error_fields
from faultline.functions.times import gap_minutes
from faultline.operators import aggregates, joins, ordering
from faultline.operators.filters import filter_exclude_noise
from faultline.plans import bursts as burst_plans
from faultline.plans import features as feature_plans
from faultline.plans import mtbf as mtbf_plans
from faultline.plans import profiles, reports, state
from faultline.plans.features import flag_logs
from faultline.session import shared_folder
from faultline.sources.results import scan_results_json

# --- SQL: MTBF --------------------------------------------------------------------
# Row by row, unlike the Spark plan: gaps, thresholds, numbered bursts, gaps of bursts.
MTBF_CTES = {
    "errors": t.ERRORS_SQL,
    "clean": t.CLEAN_SQL,
    "gaps": (
        "select *, year || month as period, epoch(timestamp)::bigint - lag(epoch(timestamp)::bigint) "
        "over (partition by year, month, host, cpu_info order by timestamp) as gap from clean"
    ),
    "kept": "select * from gaps where gap is not null",
    "limits": (
        "select period, host, count(*) as n, quantile_cont(gap, [0.25, 0.5, 0.75, 0.9]) as q "
        "from kept group by period, host having count(*) > 5"
    ),
    "thresholds": (
        "select period, host, n, unnest([0, 1, 2, 3]) as pct, unnest(q) as threshold from limits"
    ),
    "flagged": (
        "select k.period, k.host, pct, threshold, n, k.timestamp, sum(case when gap >= threshold "
        "then 1 else 0 end) over (partition by k.period, k.host, pct order by k.timestamp range "
        "between unbounded preceding and current row) as group_id from kept k join thresholds th "
        "on k.period = th.period and k.host = th.host"
    ),
    "bursts": (
        "select period, host, pct, threshold, n, group_id, min(timestamp) as min_timestamp "
        "from flagged group by all"
    ),
    "burst_gaps": (
        "select *, epoch(min_timestamp)::bigint - lag(epoch(min_timestamp)::bigint) over "
        "(partition by period, host, pct order by min_timestamp) as burst_gap from bursts"
    ),
}
MTBF_SQL = (
    "select period, host, 'percentil_' || pct as percentile, "
    "round(threshold, 6) as threshold_seconds, n as count_before, count(*) as count_after, "
    "round(case when count(burst_gap) > 2 then avg(burst_gap) end, 6) as mtbf_seconds, "
    "case when count(burst_gap) > 2 then 'ok' else 'few_bursts' end as status "
    "from burst_gaps group by period, host, pct, threshold, n "
    "union all select g.period, g.host, 'nopercetil', null, 0, 0, 0.0, 'sparse' "
    "from (select distinct period, host from gaps) g "
    "left join limits l on l.period = g.period and l.host = g.host where l.n is null"
)

# --- SQL: features ----------------------------------------------------------------
FEATURES_SQL = (
    "select f.host, f.feature_window_start, num_logs, num_errors, avg_severity, max_severity, "
    "label_feature_window, tg.target_window_start, coalesce(tg.label, 0)::int as label_next_hour, "
    "round(num_errors / num_logs, 6) as error_ratio from ("
    "select host, make_timestamp((epoch(timestamp)::bigint // {window} * {window}) * 1000000) as "
    "feature_window_start, count(*) as num_logs, sum(is_error)::bigint as num_errors, "
    "round(avg(\"Severity\"), 6) as avg_severity, max(\"Severity\") as max_severity, "
    "max(is_error) as label_feature_window from flagged group by all) f left join ("
    "select host, date_trunc('hour', timestamp) as target_window_start, max(is_error) as label "
    "from flagged group by all) tg on tg.host = f.host and "
    "tg.target_window_start = f.feature_window_start + interval {window} second"
)
ROLLING_SQL = (
    "select f.host, f.feature_window_start, num_logs, (exists (select 1 from flagged e where "
    "e.host = f.host and e.is_error = 1 and e.timestamp >= f.feature_window_start + interval "
    "{window} second and e.timestamp < f.feature_window_start + interval {window} second + "
    "interval 3600 second))::int as label_next_hour from (select host, "
    "make_timestamp((epoch(timestamp)::bigint // {window} * {window}) * 1000000) as "
    "feature_window_start, count(*) as num_logs from flagged group by all) f"
)
WINDOW_COLUMNS = (
    "host, feature_window_start, num_logs, num_errors, avg_severity, max_severity, "
    "label_feature_window"
)

# --- SQL: global bursts -----------------------------------------------------------
BURST_CTES = {
    "errors": t.ERRORS_SQL,
    "clean": t.CLEAN_SQL,
    "gaps": (
        "select *, epoch(timestamp)::bigint - lag(epoch(timestamp)::bigint) over "
        "(order by timestamp, event_id) as gap from clean"
    ),
    "grouped": (
        "select *, sum(case when gap >= 5 then 1 else 0 end) over (order by timestamp range "
        "between unbounded preceding and current row)::bigint as group_id from gaps "
        "where gap is not null"
    ),
    "bursts": (
        "select group_id, min(timestamp) as min_timestamp, "
        "sum(try_cast(number_ce_error as bigint))::bigint as number_ce_error, "
        "count(err_code) as count from grouped group by group_id"
    ),
}


def bursts_sql(select: str) -> str:
    return t.with_logs(select, **BURST_CTES)


def bursts(spark, sf_dir):
    return burst_plans.burst_table(t.errors(spark, sf_dir), tie=["event_id"])


def flagged(spark, sf_dir):
    return flag_logs(t.typed(spark, sf_dir))


def clean(spark, sf_dir):
    """Errors without noise, with the fields that gaps and bursts use."""
    rows = extract_error_fields(filter_exclude_noise(t.errors(spark, sf_dir)))
    return rows.select(
        "event_id", "timestamp", "host", "cpu_info", "err_code", "number_ce_error"
    )


def numbered(spark, sf_dir, keys):
    """Errors with row number and gap; rows of one second are in (event_id % 16, event_id) order."""
    return ordering.number_rows(
        clean(spark, sf_dir), keys, ["event_id"], spread=F.pmod("event_id", F.lit(16))
    ).withColumn("time_diff_seconds", ordering.gap_seconds("timestamp", "prev_timestamp"))


# --- Aggregations -----------------------------------------------------------------
WINDOW_SQL = (
    "select {columns} from (" + FEATURES_SQL.replace("{window}", "3600") + ")"
).replace("{columns}", WINDOW_COLUMNS)


@query(t.with_logs(WINDOW_SQL, flagged=t.FLAGGED_SQL))
def agg_window_features(spark, sf_dir):
    return aggregates.agg_window_features(flagged(spark, sf_dir), 3600)


@query(t.with_logs(WINDOW_SQL, flagged=t.FLAGGED_SQL))
def agg_two_phase_salted(spark, sf_dir):
    return aggregates.agg_two_phase_salted(flagged(spark, sf_dir), 3600)


@query(
    t.with_logs(
        "select host, date_trunc('hour', timestamp) as target_window_start, "
        "max(is_error) as label_next_hour from flagged group by all",
        flagged=t.FLAGGED_SQL,
    )
)
def agg_hourly_target(spark, sf_dir):
    return aggregates.agg_hourly_target(flagged(spark, sf_dir))


@query(t.with_logs("select distinct host from logs"))
def agg_distinct_hosts(spark, sf_dir):
    return aggregates.agg_distinct_hosts(t.logs(spark, sf_dir))


HOST_GAPS = (
    "select *, epoch(timestamp)::bigint - lag(epoch(timestamp)::bigint) over "
    "(partition by host, cpu_info order by timestamp) as gap from clean"
)


@query(
    t.with_logs(
        "select host, round(q[1], 6) as p25, round(q[2], 6) as p50, round(q[3], 6) as p75, "
        "round(q[4], 6) as p90, n as gaps from (select host, count(*) as n, quantile_cont(gap, "
        "[0.25, 0.5, 0.75, 0.9]) as q from gaps where gap is not null group by host)",
        errors=t.ERRORS_SQL,
        clean=t.CLEAN_SQL,
        gaps=HOST_GAPS,
    )
)
def agg_percentiles(spark, sf_dir):
    gaps = numbered(spark, sf_dir, ["host", "cpu_info"])
    result = aggregates.agg_percentiles(gaps.where("time_diff_seconds is not null"), ["host"])
    names = ["p25", "p50", "p75", "p90"]
    return result.select(
        "host", *[F.col("thresholds")[i].alias(name) for i, name in enumerate(names)], "gaps"
    )


@query(
    t.with_logs(
        "select host, count(*) as gaps, true as p25, true as p50, true as p75, true as p90 from gaps "
        "where gap is not null group by host",
        errors=t.ERRORS_SQL,
        clean=t.CLEAN_SQL,
        gaps=HOST_GAPS,
    )
)
def agg_percentiles_sketched(spark, sf_dir):
    """Sketches of days, merged; each percentile's rank among all gaps of the host is close."""
    gaps = numbered(spark, sf_dir, ["host", "cpu_info"]).where("time_diff_seconds is not null")
    gaps = gaps.withColumn("day", F.to_date("timestamp"))
    sketches = aggregates.gap_sketches(gaps, ["host", "day"])
    merged = aggregates.merged_percentiles(sketches, ["host"])
    ranks = [
        F.struct(
            F.count_if(F.col("time_diff_seconds") < F.col("thresholds")[i]).alias("below"),
            F.count_if(F.col("time_diff_seconds") <= F.col("thresholds")[i]).alias("up_to"),
        )
        for i in range(len(fixed.GAP_PERCENTILES))
    ]
    found = gaps.join(merged, "host").groupBy("host", "gaps").agg(F.array(*ranks).alias("ranks"))
    room = F.col("gaps") * (2 / aggregates.SKETCH_ENTRIES) + 1
    close = [
        (F.col("ranks")[i]["below"] <= p * F.col("gaps") + room) & (F.col("ranks")[i]["up_to"] >= p * F.col("gaps") - room)
        for i, p in enumerate(fixed.GAP_PERCENTILES)
    ]
    names = ["p25", "p50", "p75", "p90"]
    return found.select("host", "gaps", *[column.alias(name) for column, name in zip(close, names, strict=True)])


@query(bursts_sql("select group_id, min_timestamp, number_ce_error, count from bursts"))
def agg_bursts(spark, sf_dir):
    rows = clean(spark, sf_dir)
    first = rows.orderBy("timestamp", "event_id").limit(1).agg(F.max("event_id")).scalar()
    seconds = burst_plans.second_bursts(
        burst_plans.second_counts(t.errors(spark, sf_dir), ["event_id"]),
        fixed.GLOBAL_BURST_SECONDS,
    ).select("timestamp", "group_id")
    grouped = rows.where(F.col("event_id") != first).join(seconds, "timestamp")
    return aggregates.agg_bursts(grouped, ["group_id"])


@query(
    bursts_sql(
        "select 'all' as host, count(*) - 1 as burst_gaps, round(avg(g), 6) as mtbf_seconds from ("
        "select epoch(min_timestamp)::bigint - lag(epoch(min_timestamp)::bigint) over "
        "(order by min_timestamp) as g from bursts)"
    )
)
def agg_mean_gap(spark, sf_dir):
    starts = bursts(spark, sf_dir).withColumn("host", F.lit("all"))
    return aggregates.agg_mean_gap(starts, ["host"])


@query(
    f"with logs_long as ({t.LONG_SQL}) select month(timestamp)::int as month_number, "
    "hour(timestamp)::int as hour, count(*) as count from logs_long group by all"
)
def agg_count_by(spark, sf_dir):
    return aggregates.agg_count_by(
        t.logs_long(spark, sf_dir),
        F.month("timestamp").alias("month_number"),
        F.hour("timestamp").alias("hour"),
    )


@query(
    t.with_logs(
        "select host, percentile, string_agg(period, ',' order by period) as periods, "
        f"count(*)::bigint as size from ({MTBF_SQL}) group by host, percentile",
        15,
        **MTBF_CTES,
    )
)
def agg_collect_periods(spark, sf_dir):
    results = mtbf_plans.mtbf(t.errors(spark, sf_dir, 15))
    return aggregates.agg_collect_periods(results).withColumn(
        "periods", F.array_join("periods", ",")
    )


HEATMAP_SQL = (
    "select day_order::int as day_order, day_name, "
    + ", ".join(
        f"count(*) filter (hour({{0}}) = {hour})::bigint as h{hour:02d}" for hour in range(24)
    )
    + " from (select unnest([0,1,2,3,4,5,6]) as day_order, "
    "unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) as day_name) d "
    "left join {1} on strftime({0}, '%a') = day_name group by day_order, day_name"
)


@query(
    f"with logs_long as ({t.LONG_SQL}) " + HEATMAP_SQL.format("timestamp", "logs_long")
)
def agg_pivot_heatmap(spark, sf_dir):
    return aggregates.agg_pivot_heatmap(t.logs_long(spark, sf_dir), "timestamp")


# --- Joins ------------------------------------------------------------------------
@query(
    t.with_logs(
        f"select * exclude (error_ratio) from ({FEATURES_SQL.format(window=1800)})",
        flagged=t.FLAGGED_SQL,
    )
)
def join_features_target(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    return joins.join_features_target(
        aggregates.agg_window_features(rows, 1800), aggregates.agg_hourly_target(rows), 1800
    )


@query(t.with_logs(ROLLING_SQL.format(window=300), flagged=t.FLAGGED_SQL))
def next_hour_label_rolling(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    features = aggregates.agg_window_features(rows, 300).select(
        "host", "feature_window_start", "num_logs"
    )
    return joins.next_hour_label_rolling(features, rows, 300)


# --- Time windows -----------------------------------------------------------------
ROW_ORDER = "timestamp, event_id % 16, event_id"


def windows_sql(select: str, **ctes: str) -> str:
    return t.with_logs(select, errors=t.ERRORS_SQL, clean=t.CLEAN_SQL, **ctes)


@query(
    windows_sql(
        "select event_id, host, cpu_info, timestamp, lag(timestamp) over (partition by host, "
        f"cpu_info order by {ROW_ORDER}) as prev_timestamp from clean"
    )
)
def win_lag_by_key(spark, sf_dir):
    return numbered(spark, sf_dir, ["host", "cpu_info"]).select(
        "event_id", "host", "cpu_info", "timestamp", "prev_timestamp"
    )


@query(
    windows_sql(
        f"select event_id, timestamp, lag(timestamp) over (order by {ROW_ORDER}) as "
        "prev_timestamp from clean"
    )
)
def win_lag_global(spark, sf_dir):
    return numbered(spark, sf_dir, []).select("event_id", "timestamp", "prev_timestamp")


@query(
    windows_sql(
        "select event_id, row_number() over (partition by host, cpu_info order by "
        f"{ROW_ORDER}) as in_cpu, row_number() over (order by {ROW_ORDER}) as overall from clean"
    )
)
def win_row_number(spark, sf_dir):
    in_cpu = numbered(spark, sf_dir, ["host", "cpu_info"]).select(
        "event_id", F.col("row_number").alias("in_cpu")
    )
    overall = numbered(spark, sf_dir, []).select("event_id", F.col("row_number").alias("overall"))
    return in_cpu.join(overall, "event_id")


@query(
    windows_sql(
        "select event_id, gap as time_diff_seconds, round(gap / 60, 2) as time_diff_minutes from "
        "(select event_id, epoch(timestamp)::bigint - lag(epoch(timestamp)::bigint) over "
        f"(partition by host, cpu_info order by {ROW_ORDER}) as gap from clean) "
        "where gap is not null"
    )
)
def win_gap_seconds(spark, sf_dir):
    gap = F.col("time_diff_seconds")
    return (
        numbered(spark, sf_dir, ["host", "cpu_info"])
        .where(gap.isNotNull())
        .select("event_id", gap, gap_minutes(gap).alias("time_diff_minutes"))
    )


@query(
    windows_sql(
        "select host, event_id, timestamp, sum((gap >= 3600)::int) over (partition by host "
        "order by timestamp range between unbounded preceding and current row)::bigint as "
        "group_id from gaps where gap is not null",
        gaps=HOST_GAPS.replace("order by timestamp", f"order by {ROW_ORDER}"),
    )
)
def win_burst_id(spark, sf_dir):
    gaps = numbered(spark, sf_dir, ["host", "cpu_info"]).where("time_diff_seconds is not null")
    return ordering.burst_ids(gaps, ["host"], F.lit(3600)).select(
        "host", "event_id", "timestamp", "group_id"
    )


@query(
    bursts_sql(
        "select group_id, min_timestamp, lag(min_timestamp) over (order by min_timestamp) as "
        "prev_timestamp from bursts"
    )
)
def win_lag_burst(spark, sf_dir):
    starts = bursts(spark, sf_dir).select("group_id", "min_timestamp")
    return ordering.previous_start(starts, []).select(
        "group_id", "min_timestamp", "prev_timestamp"
    )


DAILY_CTE = (
    "select d::date as date, count(min_timestamp) as count from (select unnest(generate_series("
    "(select min(min_timestamp)::date from bursts)::timestamp, "
    "(select max(min_timestamp)::date from bursts)::timestamp, interval 1 day)) as d) "
    "left join bursts on min_timestamp::date = d::date group by d"
)
TREND_CTE = (
    "select *, case when count(*) over w = 7 then avg(count) over w end as trend, "
    "(date - (select min(date) from daily))::int % 7 as position from daily "
    "window w as (order by date rows between 3 preceding and 3 following)"
)


@query(
    t.with_logs(
        "select date, count, round(trend, 6) as trend from trends",
        **BURST_CTES,
        daily=DAILY_CTE,
        trends=TREND_CTE,
    )
)
def win_moving_average(spark, sf_dir):
    return profiles.moving_average(profiles.daily_series(bursts(spark, sf_dir)))


# --- Jobs -------------------------------------------------------------------------
@query(
    t.with_logs(
        "select timestamp, host, msg, cast(severity as varchar) as \"Severity\", year, month, day "
        "from logs",
        15,
    )
)
def collect_typed_logs(spark, sf_dir):
    from faultline.schemas import TYPED_LOGS

    rows = spark.read.schema(TYPED_LOGS).parquet(t.typed_table(spark, sf_dir))
    return rows.select("timestamp", "host", "msg", "Severity", "year", "month", "day")


@query(
    t.with_logs("select timestamp, host, msg, year, month, day from errors", 15, errors=t.ERRORS_SQL)
)
def collect_memory_errors(spark, sf_dir):
    from faultline.schemas import MEMORY_ERRORS

    return spark.read.schema(MEMORY_ERRORS).parquet(t.error_table(spark, sf_dir))


@query(t.with_logs(MTBF_SQL, **MTBF_CTES))
def mtbf(spark, sf_dir):
    return mtbf_plans.mtbf(t.errors(spark, sf_dir))


@query(
    t.with_logs(
        f"select * from ({MTBF_SQL}) where period between '202401' and '202402'",
        t.QUARTER,
        **MTBF_CTES,
    )
)
def mtbf_periods(spark, sf_dir):
    """The range leaves out the month before it and the one after it."""
    return mtbf_plans.mtbf_periods(t.errors(spark, sf_dir, t.QUARTER), "202401", "202402")


@query(bursts_sql("select group_id, min_timestamp, number_ce_error, count from bursts"))
def burst_table(spark, sf_dir):
    return bursts(spark, sf_dir)


def runs(table, by):
    """(name, rows) of each run; a run is a month or a day."""
    name = F.concat(*[F.col(column) for column in by])
    names = sorted(row[0] for row in table.select(name).distinct().collect())
    return [(run, table.where(name == run)) for run in names]


@query(
    t.with_logs(
        f"select * from ({MTBF_SQL}) where period between '202401' and '202402'",
        t.QUARTER,
        **MTBF_CTES,
    )
)
def mtbf_of_runs(spark, sf_dir):
    """Month by month with state; a month's errors are read by its own run only."""
    folder = shared_folder(spark, "mtbf-runs")
    for run, rows in runs(t.errors(spark, sf_dir, t.QUARTER), ["year", "month"]):
        state.add_mtbf_run(rows, folder, run)
    return state.mtbf_of_runs(spark, folder, "202401", "202402")


@query(bursts_sql("select group_id, min_timestamp, number_ce_error, count from bursts"))
def bursts_of_runs(spark, sf_dir):
    """Week by week with state; bursts that are open at the end of a run go on in the next."""
    folder = shared_folder(spark, "burst-runs")
    errors = t.errors(spark, sf_dir).withColumn("week", F.date_format(F.date_trunc("week", "timestamp"), "yyyyMMdd"))
    for run, rows in runs(errors, ["week"]):
        state.add_burst_run(rows, folder, run, tie=["event_id"])
    return state.bursts_of_runs(spark, folder)


@query(
    t.with_logs(
        f"select *, '2024' as year, '01' as month from ({FEATURES_SQL.format(window=3600)}) "
        "where feature_window_start < timestamp '2024-02-01'",
        15,
        flagged=t.FLAGGED_SQL,
    )
)
def feature_dataset(spark, sf_dir):
    """Logs go on after the month, so its last windows get their labels from there."""
    return feature_plans.feature_dataset(t.typed(spark, sf_dir, 15), 2024, 1, 3600)


PERIOD_WINDOWS = (300, 1800, 3600, 10800)


@query(
    t.with_logs(
        " union all ".join(
            f"select {window}::int as window_seconds, *, strftime(feature_window_start, '%Y') as "
            f"year, strftime(feature_window_start, '%m') as month from "
            f"({FEATURES_SQL.format(window=window)}) where feature_window_start >= "
            "timestamp '2024-01-01' and feature_window_start < timestamp '2024-03-01'"
            for window in PERIOD_WINDOWS
        ),
        t.QUARTER,
        flagged=t.FLAGGED_SQL,
    )
)
def feature_dataset_periods(spark, sf_dir):
    return feature_plans.feature_dataset_periods(
        t.typed(spark, sf_dir, t.QUARTER), (2024, 1), (2024, 2), PERIOD_WINDOWS
    )


@query(
    t.with_logs(
        " union all ".join(
            f"select {window}::int as window_seconds, * from ({ROLLING_SQL.format(window=window)})"
            for window in PERIOD_WINDOWS
        ),
        15,
        flagged=t.FLAGGED_SQL,
    )
)
def feature_dataset_rolling(spark, sf_dir):
    return feature_plans.feature_dataset_periods(
        t.typed(spark, sf_dir, 15), (2024, 1), (2024, 2), PERIOD_WINDOWS, "rolling"
    ).select("window_seconds", "host", "feature_window_start", "num_logs", "label_next_hour")


@query(
    bursts_sql("select hour(min_timestamp)::int as hour, count(*) as count from bursts group by 1")
)
def profile_hour(spark, sf_dir):
    return profiles.profile_hour(bursts(spark, sf_dir))


@query(
    bursts_sql(
        "select hour(min_timestamp)::int as hour, case when dayofweek(min_timestamp) between 1 "
        "and 5 then 'Semana' else 'Fin de semana' end as day_type, count(*) as count from bursts "
        "group by all"
    )
)
def profile_hour_daytype(spark, sf_dir):
    return profiles.profile_hour_daytype(bursts(spark, sf_dir))


@query(
    bursts_sql(
        "select day(min_timestamp)::int as day_of_month, count(*) as count from bursts group by 1"
    )
)
def profile_day_of_month(spark, sf_dir):
    return profiles.profile_day_of_month(bursts(spark, sf_dir))


@query(
    bursts_sql(
        "select case when day(min_timestamp) <= 10 then 'Inicio' when day(min_timestamp) <= 20 "
        "then 'Mitad' else 'Final' end as month_third, count(*) as count from bursts group by 1"
    )
)
def profile_month_third(spark, sf_dir):
    return profiles.profile_month_third(bursts(spark, sf_dir))


LONG_BURSTS = f"with bursts as (select timestamp as min_timestamp from ({t.LONG_SQL}) where is_error = 1) "


def long_starts(spark, sf_dir):
    """Error times over years, as a stand-in for burst starts over years."""
    rows = t.logs_long(spark, sf_dir).where(error_field("ce_error", F.col("msg")) != "")
    return rows.select(F.col("timestamp").alias("min_timestamp"))


@query(
    LONG_BURSTS + "select month(min_timestamp)::int as month_number, strftime(min_timestamp, '%B') "
    "as month_name, count(*) as count from bursts group by all"
)
def profile_month(spark, sf_dir):
    return profiles.profile_month(long_starts(spark, sf_dir))


@query(
    t.with_logs("select date, count from daily", **BURST_CTES, daily=DAILY_CTE)
)
def daily_series(spark, sf_dir):
    return profiles.daily_series(bursts(spark, sf_dir))


@query(
    LONG_BURSTS + f", daily as ({DAILY_CTE}), trends as ({TREND_CTE}), means as (select position, "
    "avg(count - trend) as m from trends group by position) select date, count, "
    "round(trend, 6) as trend, round(m - (select avg(m) from means), 6) as seasonal, "
    "round(count - trend - (m - (select avg(m) from means)), 6) as residual "
    "from trends join means using (position)"
)
def seasonal_decompose(spark, sf_dir):
    return profiles.seasonal_decompose(profiles.daily_series(long_starts(spark, sf_dir)))


@query(bursts_sql(HEATMAP_SQL.format("min_timestamp", "bursts")))
def heatmap_day_hour(spark, sf_dir):
    return profiles.heatmap_day_hour(bursts(spark, sf_dir))


LABEL_SQL = (
    "case percentile when 'percentil_0' then '25%' when 'percentil_1' then '50%' "
    "when 'percentil_2' then '75%' when 'percentil_3' then '90%' else 'N/A' end"
)


@query(
    t.with_logs(
        f"select {LABEL_SQL} as percentile, host, strptime(period, '%Y%m')::date as date, "
        f"mtbf_seconds from ({MTBF_SQL}) where percentile <> 'nopercetil'",
        15,
        **MTBF_CTES,
    )
)
def mtbf_evolution(spark, sf_dir):
    results = scan_results_json(spark, t.result_table(spark, sf_dir))
    return reports.mtbf_evolution(results, ["25%", "50%", "75%", "90%"])


@query(
    t.with_logs(
        f"select {LABEL_SQL} as percentile, host, string_agg(period, ',' order by period) as "
        f"periods, count(*)::bigint as size from ({MTBF_SQL}) group by 1, 2",
        15,
        **MTBF_CTES,
    )
)
def host_coverage(spark, sf_dir):
    results = scan_results_json(spark, t.result_table(spark, sf_dir))
    return reports.host_coverage(results).withColumn("periods", F.array_join("periods", ","))
