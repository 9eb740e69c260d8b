import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators.aggregates import (
    agg_hourly_target,
    agg_two_phase_salted,
    agg_window_features,
)
from faultline.operators.joins import join_features_target, next_hour_label_rolling
from faultline.plans.features import (
    feature_dataset,
    feature_dataset_periods,
    flag_logs,
    window_features,
)

ERROR = "EDAC 1 CE memory read error on CPU_SrcID#0_Ha#0_Chan#0_DIMM#0"
MESSAGES = {0: "all well", 1: ERROR, None: None}
EPOCH = dt.datetime(1970, 1, 1)


def second(text):
    return int((dt.datetime.fromisoformat(text) - EPOCH).total_seconds())


def typed(spark, at, rows):
    """(host, second, severity, error 0 / 1 / NULL message) rows as typed logs."""
    rows = [(host, s, severity, MESSAGES[error]) for host, s, severity, error in rows]
    table = spark.createDataFrame(rows, "host string, second bigint, Severity string, msg string")
    return table.withColumn("timestamp", at()).withColumns(
        {
            "year": F.date_format("timestamp", "yyyy"),
            "month": F.date_format("timestamp", "MM"),
            "day": F.date_format("timestamp", "dd"),
        }
    )


def naive(rows, window, mode):
    rows = [(host.strip() and host or "UNKNOWN_HOST", s, sev, e) for host, s, sev, e in rows]
    hours = {}
    for host, s, _, error in rows:
        hours.setdefault((host, s // 3600 * 3600), []).append(error)
    result = {}
    for host, start in {(host, s // window * window) for host, s, _, _ in rows}:
        mine = [r for r in rows if r[0] == host and r[1] // window * window == start]
        flags = [r[3] for r in mine if r[3] is not None]
        levels = [int(r[2]) for r in mine if r[2] is not None]
        end = start + window
        if mode == "aligned":
            label = int(1 in hours.get((host, end), []))
            target = end if (host, end) in hours else None
        else:
            label = int(any(r[0] == host and r[3] == 1 and end <= r[1] < end + 3600 for r in rows))
            target = None
        result[host, start] = (
            len(mine),
            sum(flags) if flags else None,
            sum(levels) / len(levels) if levels else None,
            max(levels) if levels else None,
            max(flags) if flags else None,
            target,
            label,
            sum(flags) / len(mine) if flags else None,
        )
    return result


def found(features):
    rows = features.select(
        "host",
        F.unix_seconds("feature_window_start"),
        "num_logs",
        "num_errors",
        "avg_severity",
        "max_severity",
        "label_feature_window",
        F.unix_seconds("target_window_start"),
        "label_next_hour",
        "error_ratio",
    ).collect()
    return {tuple(row[:2]): tuple(row[2:]) for row in rows}


def random_rows(seed, count=250, span=200000):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["a", "a", "a", "b", " "]),
            rng.choice([rng.randint(0, span), rng.randint(0, span) // 3600 * 3600]),
            rng.choice(["0", "3", "7", None]),
            rng.choice([0, 0, 0, 1, None]),
        )
        for _ in range(count)
    ]


@pytest.mark.parametrize("mode", ["aligned", "rolling"])
@pytest.mark.parametrize("window", [300, 420, 1800, 3600, 5400, 10800, 25200])
def test_equals_naive(spark, at, window, mode):
    rows = random_rows(window)
    flagged = flag_logs(typed(spark, at, rows).repartition(5))
    assert found(window_features(flagged, [window], mode)) == naive(rows, window, mode)


def test_several_windows_at_once(spark, at):
    rows = random_rows(1)
    flagged = flag_logs(typed(spark, at, rows))
    both = window_features(flagged, [300, 5400])
    for window in (300, 5400):
        assert found(both.where(F.col("window_seconds") == window)) == naive(rows, window, "aligned")


def test_unknown_mode(spark, at):
    with pytest.raises(ValueError):
        window_features(flag_logs(typed(spark, at, random_rows(1, 3))), [300], "other")


def test_step_by_step_and_salted_forms_agree(spark, at):
    rows = random_rows(2)
    flagged = flag_logs(typed(spark, at, rows))
    for window in (1800, 10800):
        features = agg_window_features(flagged, window)
        joined = join_features_target(features, agg_hourly_target(flagged), window)
        one_pass = window_features(flagged, [window]).select(joined.columns)
        assert joined.exceptAll(one_pass).isEmpty() and one_pass.exceptAll(joined).isEmpty()
        salted = agg_two_phase_salted(flagged, window, salts=7).select(features.columns)
        assert features.exceptAll(salted).isEmpty() and salted.exceptAll(features).isEmpty()
        rolling = next_hour_label_rolling(features, flagged, window).select(
            "host", "feature_window_start", "label_next_hour"
        )
        expected = window_features(flagged, [window], "rolling").select(rolling.columns)
        assert rolling.exceptAll(expected).isEmpty() and expected.exceptAll(rolling).isEmpty()


@pytest.mark.parametrize("offset,label", [(-1, 0), (0, 1), (3599, 1), (3600, 0)])
@pytest.mark.parametrize("mode", ["aligned", "rolling"])
def test_label_limits(spark, at, offset, label, mode):
    rows = [("a", 7200, "1", 0), ("a", 10800 + offset, "1", 1)]
    features = window_features(flag_logs(typed(spark, at, rows)), [3600], mode)
    assert found(features)["a", 7200][6] == label


def test_window_that_ends_off_the_hour(spark, at):
    rows = [("a", 7200, "1", 0), ("a", 7600, "1", 1)]
    flagged = flag_logs(typed(spark, at, rows))
    assert found(window_features(flagged, [300], "aligned"))["a", 7200][6] == 0
    assert found(window_features(flagged, [300], "rolling"))["a", 7200][6] == 1


def test_month_end_and_year_end(spark, at):
    rows = [
        ("a", second("2021-12-31 23:30:00"), "1", 0),
        ("a", second("2022-01-01 00:30:00"), "1", 1),
        ("a", second("2022-01-01 02:10:00"), "1", 1),
        ("a", second("2022-01-31 22:59:59"), "1", 0),
    ]
    logs = typed(spark, at, rows)
    december = feature_dataset(logs, 2021, 12, 3600).collect()
    assert [(r.label_next_hour, r.year, r.month) for r in december] == [(1, "2021", "12")]
    january = feature_dataset(logs, 2022, 1, 3600).collect()
    assert sorted(r.label_next_hour for r in january) == [0, 0, 0]
    both = feature_dataset_periods(logs, (2021, 12), (2022, 1), [3600])
    assert sorted(r.label_next_hour for r in both.collect()) == [0, 0, 0, 1]
    assert feature_dataset(logs, 2022, 2, 3600).isEmpty()


def test_lookahead_of_more_than_a_day(spark, at):
    two_days = 2 * 86400
    start = second("2022-03-31 00:00:00") // two_days * two_days
    rows = [("a", start, "1", 0), ("a", start + two_days + 60, "1", 1)]
    month = dt.datetime.fromtimestamp(start, dt.timezone.utc)
    features = feature_dataset(typed(spark, at, rows), month.year, month.month, two_days)
    assert [r.label_next_hour for r in features.collect()][:1] == [1]
