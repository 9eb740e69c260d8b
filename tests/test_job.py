"""The submitted jobs write what the functions return."""

import pytest

from checks import tables as t
from faultline import job
from faultline.plans import state
from faultline.plans.bursts import burst_table
from faultline.plans.learning import ml_prepare, score_model
from faultline.plans.mtbf import mtbf_periods
from faultline.schemas import FEATURES, MEMORY_ERRORS, TYPED_LOGS
from faultline.sinks.models import read_model
from faultline.sources.results import scan_results_json

SMALL = "/root/testdata/sf0.001"


def test_jobs_in_a_row(spark, tmp_path):
    def call(*words):
        job.run(spark, job.arguments(list(words)))

    raw = t.raw_table(spark, SMALL)
    logs, errors, features, results = (str(tmp_path / n) for n in ("logs", "errors", "features", "results"))
    call("logs", raw, logs, "--first", "20240101", "--last", "20240301")
    assert spark.read.schema(TYPED_LOGS).parquet(logs).count() == spark.read.parquet(raw).count()
    call("errors", raw, errors, "--first", "20240101", "--last", "20240301")
    table = spark.read.schema(MEMORY_ERRORS).parquet(errors)
    assert table.count() > 0
    call("mtbf", errors, results, "--first", "202401", "--last", "202402")
    assert scan_results_json(spark, results).count() == mtbf_periods(table, "202401", "202402").count()
    call("features", logs, features, "--first", "202401", "--last", "202402", "--window", "30 minutes")
    rows = spark.read.schema(FEATURES).parquet(features)
    assert rows.agg({"num_logs": "sum"}).first()[0] == spark.read.parquet(logs).count()

    again, reported, bursts, found = (str(tmp_path / n) for n in ("again", "reports", "bursts", "profiles"))
    call("errors", logs, again, "--first", "20240101", "--last", "20240301", "--typed")
    assert spark.read.schema(MEMORY_ERRORS).parquet(again).exceptAll(table).isEmpty()
    call("compact", again, "--file-mb", "1")
    assert spark.read.schema(MEMORY_ERRORS).parquet(again).count() == table.count()
    call("reports", results, reported)
    assert spark.read.parquet(f"{reported}/evolution").count() > 0
    assert spark.read.parquet(f"{reported}/coverage").count() > 0
    call("bursts", errors, bursts, "--first", "202401", "--last", "202402")
    rows = spark.read.parquet(bursts)
    assert rows.count() == burst_table(table).count()
    call("profiles", bursts, found)
    assert spark.read.parquet(f"{found}/hour").agg({"count": "sum"}).first()[0] == rows.count()
    assert spark.read.parquet(f"{found}/heatmap").count() == 7

    runs = str(tmp_path / "runs")
    for month in ("202401", "202402"):
        call("run", errors, runs, "--first", month, "--last", month)
    assert state.bursts_of_runs(spark, runs).count() == rows.count()


def test_several_windows_and_chosen_hosts(spark, tmp_path):
    logs, target = t.typed_table(spark, SMALL), str(tmp_path / "features")
    words = ["features", logs, target, "--first", "202401", "--last", "202402", "--window", "30 minutes", "2 hours"]
    job.run(spark, job.arguments([*words, "--hosts", "c205", "c206"]))
    chosen = spark.read.parquet(logs).where("host like 'c205%' or host like 'c206%'").count()
    for folder in ("minutes=30", "hour=2"):
        rows = spark.read.schema(FEATURES).parquet(f"{target}/{folder}")
        assert rows.agg({"num_logs": "sum"}).first()[0] == chosen > 0
        assert {r.host[:4] for r in rows.select("host").distinct().collect()} == {"c205", "c206"}


@pytest.mark.parametrize("kind", ["lr", "boosted"])
def test_train_and_report(spark, tmp_path, kind):
    source, target = t.january_features(spark, "/root/testdata/sf0.01"), str(tmp_path / "trained")
    words = ["train", source, target, "--model", kind, "--rounds", "4", "--negative-fraction", "0.5"]
    job.run(spark, job.arguments([*words, "--thresholds", "0.1", "0.5", "--balanced"]))
    tables = {n: spark.read.parquet(f"{target}/{n}") for n in (
        "classes", "areas", "report", "roc_curve", "pr_curve", "threshold_curve", "importance", "permutation",
    )}
    features = spark.read.schema(FEATURES).parquet(source)
    rows = {r.part: r.rows for r in tables["classes"].collect()}
    assert rows["test"] == features.count() - int(features.count() * 0.8) and rows["sampled"] > 0
    areas = {r.measure: r.value for r in tables["areas"].collect()}
    assert 0 <= areas["roc_auc"] <= 1 and areas["log_loss"] > 0
    assert {r.threshold for r in tables["report"].select("threshold").collect()} == {0.1, 0.5}
    assert tables["threshold_curve"].count() == 101 and tables["importance"].count() == 10
    assert tables["permutation"].count() == 10
    scores = score_model(read_model(f"{target}/model"), ml_prepare(features))
    assert scores.where("score is null").isEmpty()


@pytest.mark.parametrize(
    "words",
    [["features", "a/b", "c", "--first", "2024-1", "--last", "202402"], ["mtbf", "a/b", "c"], ["other", "a", "b"],
     ["features", "a/b", "c", "--first", "202413", "--last", "202402"]],
)
def test_wrong_words_are_refused(words):
    with pytest.raises(SystemExit):
        job.arguments(words)
