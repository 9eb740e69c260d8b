import pytest
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions import parse, times


def test_normalize_logs(spark):
    rows = [
        ({"timestamp": "1667088000123", "host": "a", "Severity": "3"}, bytearray(b"\xe1 b"), 1),
        ({"timestamp": "soon", "Severity": "high"}, None, 2),
        ({"timestamp": "1667088000999.75", "host": " "}, bytearray(b"x"), 3),
        ({"timestamp": "-1500", "host": "b"}, bytearray(b"y"), 4),
        ({}, bytearray(b""), 5),
    ]
    raw = spark.createDataFrame(rows, "headers map<string,string>, body binary, id int")
    typed = parse.normalize_logs(raw)
    assert "body" not in typed.columns and "headers" in typed.columns
    found = {
        row.id: row
        for row in typed.withColumn("second", F.unix_seconds("timestamp")).collect()
    }
    assert found[1].msg == "á b" and found[1].second == 1667088000
    assert found[2].msg is None and found[2].second is None and found[2].host is None
    assert found[3].second == 1667088000
    assert found[4].second == -1  # cut towards zero
    assert found[5].msg == "" and found[5].priority is None


def test_hours_stay_apart_when_clocks_go_back(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        rows = spark.createDataFrame([("1667088000000",), ("1667091600000",)], "text string")
        seconds = rows.select(F.unix_seconds(parse.epoch_ms_to_ts(F.col("text"))))
        assert sorted(row[0] for row in seconds.collect()) == [1667088000, 1667091600]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_severity_and_host(spark):
    rows = spark.createDataFrame(
        [("3", "a"), ("3.9", " "), ("x", None), (None, "  b ")], "severity string, host string"
    ).select(
        parse.severity_int(F.col("severity")), parse.host_or_unknown(F.col("host"))
    )
    assert [tuple(row) for row in rows.collect()] == [
        (3, "a"), (3, fixed.UNKNOWN_HOST), (None, fixed.UNKNOWN_HOST), (None, "  b ")
    ]


MESSAGES = {
    "EDAC MC0: 2 CE memory read error on CPU_SrcID#1_Ha#0_Chan#3_DIMM#2 (channel:3 slot:2 "
    "page:0x1f err_code:0x0101:0x0091)": ("CE", "1", "3", "2"),
    "EDAC 1 UE on CPU_SrcID#0_MC#1_Chan#0_DIMM#0": ("UE", "0", "0", "0"),
    "1 CE memory read error": ("", "", "", ""),
    "CPU_SrcID#0_Ha#0_Chan#0_DIMM#0": ("", "", "", ""),
    "ACE CPU_SrcID#0_Ha#0_Chan#0_DIMM#0": ("", "", "", ""),
    "first line CE\nsecond line CPU_SrcID#0_Ha#0_Chan#0_DIMM#0": ("", "", "", ""),
    "": ("", "", "", ""),
}


def test_error_class_and_locator(spark):
    rows = spark.createDataFrame([(m,) for m in [*MESSAGES, None]], "msg string")
    columns = [
        "msg",
        parse.classify_error(F.col("msg")).alias("error_class"),
        *parse.parse_dimm_locator(F.col("msg")),
        parse.error_flag(parse.classify_error(F.col("msg"))).alias("flag"),
    ]
    for row in rows.select(*columns).collect():
        if row.msg is None:
            assert row.error_class is None and row.flag is None and row.dimm is None
        else:
            expected = MESSAGES[row.msg]
            assert (row.error_class, row.socket, row.channel, row.dimm) == expected
            assert row.flag == int(expected[0] != "")


def test_literal_check_changes_no_class(spark):
    rows = spark.createDataFrame([(m,) for m in [*MESSAGES, None]], "msg string")
    plain = F.regexp_extract("msg", fixed.ERROR_CLASS_PATTERN, 1)
    assert rows.where(~plain.eqNullSafe(parse.classify_error(F.col("msg")))).count() == 0


def test_error_fields(spark):
    rows = spark.createDataFrame([(next(iter(MESSAGES)),), (None,)], "msg string")
    found, missing = parse.extract_error_fields(rows).collect()
    assert (found.channel, found.page, found.err_code) == ("3", "0x1f", "0x0101:0x0091")
    assert found.cpu_info == "CPU_SrcID#1_Ha#0_Chan#3_DIMM#2"
    assert (found.ce_error, found.number_ce_error) == ("2 CE memory read error", "2")
    assert found.ChipId == "" and missing.channel is None
    assert len(found) == 1 + len(fixed.ERROR_FIELD_PATTERNS) + 1


def test_window_sizes():
    assert times.parse_window_size("30 minutes") == 1800
    assert times.parse_window_size("1 hour") == 3600
    assert times.parse_window_size("5 min") == 300
    for wrong in ("1 day", "10 s"):
        with pytest.raises(ValueError):
            times.parse_window_size(wrong)


def test_time_bucket_before_1970(spark, at):
    seconds = [-7201, -7200, -1, 0, 3599, 3600]
    rows = spark.createDataFrame([(s,) for s in seconds], "second bigint")
    starts = rows.select("second", F.unix_seconds(times.time_bucket(at(), 3600)))
    assert {s: b for s, b in starts.collect()} == {s: s // 3600 * 3600 for s in seconds}


def test_months(spark):
    assert times.month_after(2022, 12) == (2023, 1) and times.month_after(2024, 1) == (2024, 2)
    row = spark.range(1).select(*times.month_bounds(F.lit(2022), F.lit(12))).first()
    assert (row.next_year, row.next_month) == (2023, 1)
    periods = spark.createDataFrame([("20228",), ("202208",), ("202212",)], "p string")
    dates = [str(r[0]) for r in periods.select(times.parse_period(F.col("p"))).collect()]
    assert dates == ["2022-08-01", "2022-08-01", "2022-12-01"]
