"""Result order, minimum sizes and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_by(table: DataFrame, *order: Column | str) -> DataFrame:
    """For the last step of a query; earlier sorts are lost in the next shuffle."""
    return table.orderBy(*order)


def limit_threshold(table: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` rows, and their number of rows."""
    counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > more_than)


def topk_features(weights: DataFrame, count: int = 10, largest: bool = True) -> DataFrame:
    weight = F.col("weight").desc() if largest else F.col("weight").asc()
    return weights.orderBy(weight, "feature").limit(count)
