import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.plans import profiles, reports
from faultline.sinks.results import result_documents, sink_results_json, sink_to_driver
from faultline.sources.results import scan_results_json

DAY = dt.date(2024, 1, 1)


def series(spark, counts):
    rows = [(DAY + dt.timedelta(days=i), count) for i, count in enumerate(counts)]
    return spark.createDataFrame(rows, "date date, count bigint")


@pytest.mark.parametrize("length", [3, 6, 7, 13, 21, 40])
def test_seasonal_decompose(spark, length):
    counts = [(i * 7919) % 23 + i for i in range(length)]
    rows = profiles.seasonal_decompose(series(spark, counts)).collect()
    assert [r.date for r in rows] == [DAY + dt.timedelta(days=i) for i in range(length)]
    trend = [
        np.mean(counts[i - 3 : i + 4]) if 3 <= i < length - 3 else np.nan for i in range(length)
    ]
    rest = np.array(counts) - np.array(trend)
    present = [rest[p::7][~np.isnan(rest[p::7])] for p in range(min(7, length))]
    means = np.array([part.mean() if len(part) else np.nan for part in present])
    season = means - (np.nanmean(means) if not np.isnan(means).all() else np.nan)
    for i, row in enumerate(rows):
        for value, expected in (
            (row.trend, trend[i]),
            (row.seasonal, season[i % 7]),
            (row.residual, rest[i] - season[i % 7]),
        ):
            assert value is None if np.isnan(expected) else value == pytest.approx(expected)


def test_daily_series_fills_missing_days(spark):
    starts = spark.createDataFrame(
        [(dt.datetime(2024, 2, 27, 12),), (dt.datetime(2024, 3, 1, 12),), (dt.datetime(2024, 3, 1, 13),)],
        "min_timestamp timestamp",
    )
    rows = profiles.daily_series(starts).collect()
    assert [(r.date.day, r["count"]) for r in rows] == [(27, 1), (28, 0), (29, 0), (1, 2)]
    assert profiles.daily_series(starts.limit(0)).isEmpty()


def test_results_round_trip_and_other_writers(spark, tmp_path):
    rows = [
        ("202208", "c1", "percentil_0", 10, 5, 33.5),
        ("202208", "c1", "percentil_1", 10, 3, None),
        ("202208", "c2", "nopercetil", 0, 0, 0.0),
        ("202212", "c1", "percentil_0", 9, 4, 1.0),
    ]
    columns = "period string, host string, percentile string, count_before bigint, count_after bigint, mtbf_seconds double"
    results = spark.createDataFrame(rows, columns)
    path = str(tmp_path / "results")
    sink_results_json(results, path, hosts_per_document=1)
    sink_results_json(results.where("period = '202212'"), path, hosts_per_document=1)
    read = [tuple(r) for r in scan_results_json(spark, path).collect()]
    assert len(read) == len(rows) and set(read) == set(rows)

    documents = [json.loads(r.value) for r in result_documents(results).collect()]
    merged = {key: value for document in documents for key, value in document.items()}
    assert set(merged) == {"20228", "202212"}
    assert merged["20228"]["c1"]["percentil_1"] == {
        "count_before": 10, "count_after": 3, "mbtf": None
    }

    written = {"20221": {"c9": {"percentil_3": {"count_before": 8, "count_after": 4, "mtbf": 2.5}}}}
    (tmp_path / "fichero_resultados_202201.json").write_text(json.dumps(written, indent=4))
    other = scan_results_json(spark, str(tmp_path / "fichero_resultados_*.json"))
    assert [tuple(r) for r in other.collect()] == [("202201", "c9", "percentil_3", 8, 4, 2.5)]


def test_reports(spark):
    rows = [(f"2022{m:02d}", "a", "percentil_1", float(m)) for m in (3, 1, 2)]
    rows += [("202201", "b", "nopercetil", 0.0)]
    results = spark.createDataFrame(
        rows, "period string, host string, percentile string, mtbf_seconds double"
    )
    evolution = reports.mtbf_evolution(results, ["50%"], ["a"]).collect()
    assert [r.mtbf_seconds for r in evolution] == [1.0, 2.0, 3.0]
    assert reports.mtbf_evolution(results).count() == 4
    first = reports.host_coverage(results).first()
    assert (first.host, first.percentile, first.size) == ("a", "50%", 3)
    assert first.periods == ["202201", "202202", "202203"]
    assert len(sink_to_driver(results)) == len(sink_to_driver(results, 4)) == 4
    with pytest.raises(ValueError, match="more than 2 rows"):
        sink_to_driver(results, 2)


def test_heatmap_has_every_day(spark):
    starts = spark.createDataFrame([(dt.datetime(2024, 1, 3, 12),)], "min_timestamp timestamp")
    rows = profiles.heatmap_day_hour(starts).collect()
    assert [r.day_name for r in rows] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert sum(sum(r[f"h{h:02d}"] for h in range(24)) for r in rows) == 1


def test_profiles_by_weekday_and_third(spark):
    days = [dt.datetime(2024, 1, d, 12) for d in (5, 6, 7, 8, 10, 11, 20, 21)]
    starts = spark.createDataFrame([(d,) for d in days], "min_timestamp timestamp")
    kinds = {r.day_type: r["count"] for r in profiles.profile_hour_daytype(starts).groupBy("day_type").agg(F.sum("count").alias("count")).collect()}
    assert kinds == {"Semana": 4, "Fin de semana": 4}
    thirds = {r.month_third: r["count"] for r in profiles.profile_month_third(starts).collect()}
    assert thirds == {"Inicio": 5, "Mitad": 2, "Final": 1}
