"""Steps that add, fill or drop columns of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed


def error_ratio(errors: Column, logs: Column) -> Column:
    """NULL, not an error, where there are no logs."""
    return F.try_divide(errors, logs)


def fill_defaults(table: DataFrame, defaults: Mapping[str, int | float | str]) -> DataFrame:
    return table.fillna(dict(defaults))


def drop_if_present(table: DataFrame, *names: str) -> DataFrame:
    return table.drop(*names)


def log_intensity(features: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Log count relative to the mean log count of ``fit_on``, by default of all rows.

    The mean is a scalar subquery: one partial sum per task, no join.
    """
    source = features if fit_on is None else fit_on
    mean = source.agg(F.avg("num_logs")).scalar()
    return features.withColumn(
        "log_intensity", F.col("num_logs") / (mean + F.lit(fixed.SMOOTHING))
    )
