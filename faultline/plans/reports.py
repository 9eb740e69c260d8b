"""Reports on MTBF results of many months."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.calendars import percentile_label
from faultline.functions.times import parse_period
from faultline.operators.aggregates import agg_collect_periods
from faultline.operators.filters import filter_in_list


def labelled_results(results: DataFrame) -> DataFrame:
    return results.withColumns(
        {
            "percentile": percentile_label(F.col("percentile")),
            "date": parse_period(F.col("period")),
        }
    )


def mtbf_evolution(
    results: DataFrame,
    percentiles: Iterable[str] | None = None,
    hosts: Iterable[str] | None = None,
) -> DataFrame:
    """MTBF by month per percentile label and host, for all or the given ones."""
    rows = filter_in_list(labelled_results(results), "percentile", percentiles)
    return (
        filter_in_list(rows, "host", hosts)
        .select("percentile", "host", "date", "mtbf_seconds")
        .orderBy("percentile", "host", "date")
    )


def host_coverage(results: DataFrame) -> DataFrame:
    """Per host and percentile label: the months with results, most months first."""
    return agg_collect_periods(labelled_results(results)).orderBy(
        F.desc("size"), "host", "percentile"
    )
