"""Jobs to submit: ``spark-submit --py-files faultline.zip faultline/job.py <job> ...``.

A job covers its whole range of days or months at once. Sessions take their resources from
spark-submit; what results depend on is set here.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.times import parse_window_size
from faultline.operators.filters import filter_host_prefixes
from faultline.plans import profiles, reports, state
from faultline.plans.bursts import burst_table
from faultline.plans.collect import collect_memory_errors, collect_typed_logs, collect_typed_memory_errors
from faultline.plans.features import MODES, feature_dataset_periods
from faultline.plans.mtbf import mtbf_periods, period_column
from faultline.plans.training import KINDS, sink_training, train_and_report
from faultline.schemas import MEMORY_ERRORS, TYPED_LOGS
from faultline.session import build_session, work_tables
from faultline.sinks.results import sink_results_json
from faultline.sinks.tables import compact_memory_errors, sink_features_month, written_table
from faultline.sources.results import scan_results_json
from faultline.sources.tables import read_table, scan_feature_dataset

DAYS, MONTHS = ("logs", "errors"), ("mtbf", "features", "bursts", "run")
PROFILES = {
    "hour": profiles.profile_hour,
    "hour_daytype": profiles.profile_hour_daytype,
    "day_of_month": profiles.profile_day_of_month,
    "month_third": profiles.profile_month_third,
    "month": profiles.profile_month,
    "heatmap": profiles.heatmap_day_hour,
}


def month(text: str) -> tuple[int, int]:
    year, number = int(text[:4]), int(text[4:])
    if len(text) != 6 or not 1 <= number <= 12:
        raise argparse.ArgumentTypeError(f"a month is written yyyyMM, not {text!r}")
    return year, number


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Log reliability jobs.")
    jobs = parser.add_subparsers(dest="job", required=True)
    made = {}
    for name in (*DAYS, *MONTHS, "profiles", "reports", "train"):
        job = made[name] = jobs.add_parser(name)
        job.add_argument("source", help="table name, or path of a table")
        job.add_argument("target", help="path to write to")
        if name in (*DAYS, *MONTHS):
            unit = "yyyyMMdd" if name in DAYS else "yyyyMM"
            kind = month if name == "features" else str
            job.add_argument("--first", required=True, type=kind, help=unit)
            job.add_argument("--last", required=True, type=kind, help=f"{unit}, included")
    made["errors"].add_argument("--host", help="one host instead of all known ones")
    made["errors"].add_argument("--typed", action="store_true", help="the source is typed logs, not raw ones")
    made["features"].add_argument(
        "--window", nargs="+", default=["1 hour"], help="'30 minutes', '1 hour' and the like; several at once"
    )
    made["features"].add_argument("--mode", default=MODES[0], choices=MODES)
    made["features"].add_argument("--hosts", nargs="+", help="first letters of the hosts wanted")
    made["reports"].add_argument("--hosts", nargs="+", help="hosts wanted")
    made["reports"].add_argument("--percentiles", nargs="+", help="labels such as 50%%")
    train = made["train"]
    train.add_argument("--model", default="boosted", choices=KINDS)
    train.add_argument("--rounds", type=int, default=300)
    train.add_argument("--train-fraction", type=float, default=fixed.TRAIN_FRACTION)
    train.add_argument("--negative-fraction", type=float, default=fixed.NEGATIVE_FRACTION)
    train.add_argument("--thresholds", type=float, nargs="+", default=list(fixed.REPORT_THRESHOLDS))
    train.add_argument("--balanced", action="store_true", help="positives weigh as much as negatives")
    compact = jobs.add_parser("compact", help="rewrite days of a memory-error table that lie in many files")
    compact.add_argument("target", help="path of the table")
    compact.add_argument("--file-mb", type=int, default=128)
    return parser.parse_args(words)


def errors_of_months(spark: SparkSession, source: str, first: str, last: str) -> DataFrame:
    errors = read_table(spark, source, MEMORY_ERRORS)
    in_years = F.col("year").between(first[:4], last[:4])
    return errors.where(in_years & period_column().between(first, last))


def window_folder(text: str) -> str:
    """Folder of a window size, such as hour=1 or minutes=30."""
    number, unit = text.split()
    return f"{'hour' if unit.startswith('hour') else 'minutes'}={int(number)}"


def feature_job(spark: SparkSession, wanted: argparse.Namespace) -> None:
    """One window size is written to the target itself, several to a folder each."""
    logs = read_table(spark, wanted.source, TYPED_LOGS)
    if wanted.hosts:
        logs = filter_host_prefixes(logs, wanted.hosts)
    sizes = {text: parse_window_size(text) for text in wanted.window}
    rows = feature_dataset_periods(logs, wanted.first, wanted.last, list(sizes.values()), wanted.mode)
    if len(sizes) == 1:
        sink_features_month(rows.drop("window_seconds"), wanted.target)
        return
    rows = written_table(rows, "features")
    for text, seconds in sizes.items():
        part = rows.where(F.col("window_seconds") == seconds).drop("window_seconds")
        sink_features_month(part, f"{wanted.target}/{window_folder(text)}")


def profile_job(spark: SparkSession, wanted: argparse.Namespace) -> None:
    bursts = read_table(spark, wanted.source)
    for name, profile in PROFILES.items():
        profile(bursts).write.mode("overwrite").parquet(f"{wanted.target}/{name}")
    series = profiles.daily_series(bursts)
    series.write.mode("overwrite").parquet(f"{wanted.target}/daily_series")
    profiles.seasonal_decompose(series).write.mode("overwrite").parquet(f"{wanted.target}/seasons")


def run(spark: SparkSession, wanted: argparse.Namespace) -> None:
    if wanted.job == "compact":
        with work_tables(spark):
            compact_memory_errors(spark, wanted.target, wanted.file_mb << 20)
        return
    source, target = wanted.source, wanted.target
    first, last = getattr(wanted, "first", None), getattr(wanted, "last", None)
    with work_tables(spark):
        if wanted.job == "logs":
            collect_typed_logs(spark, source, target, first, last)
        elif wanted.job == "errors":
            collect = collect_typed_memory_errors if wanted.typed else collect_memory_errors
            collect(spark, source, target, first, last, wanted.host)
        elif wanted.job == "mtbf":
            sink_results_json(mtbf_periods(read_table(spark, source, MEMORY_ERRORS), first, last), target)
        elif wanted.job == "features":
            feature_job(spark, wanted)
        elif wanted.job == "bursts":
            burst_table(errors_of_months(spark, source, first, last)).write.mode("overwrite").parquet(target)
        elif wanted.job == "run":
            errors = errors_of_months(spark, source, first, last)
            state.add_mtbf_run(errors, target, first)
            state.add_burst_run(errors, target, first)
        elif wanted.job == "profiles":
            profile_job(spark, wanted)
        elif wanted.job == "reports":
            results = written_table(scan_results_json(spark, source), "results")
            evolution = reports.mtbf_evolution(results, wanted.percentiles, wanted.hosts)
            evolution.write.mode("overwrite").parquet(f"{target}/evolution")
            reports.host_coverage(results).write.mode("overwrite").parquet(f"{target}/coverage")
        else:
            features = scan_feature_dataset(spark, f"{source}/year=*/month=*", source)
            model, tables = train_and_report(
                features, wanted.model, wanted.train_fraction, wanted.negative_fraction,
                wanted.rounds, wanted.balanced, wanted.thresholds,
            )
            sink_training(model, tables, target)


def main() -> None:
    wanted = arguments()
    spark = build_session(f"faultline-{wanted.job}")
    try:
        run(spark, wanted)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
