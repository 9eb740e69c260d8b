"""Appending tables to each other."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE_PARTITIONS = ("year", "month", "day")


def union_all_positional(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def union_by_name(
    left: DataFrame, right: DataFrame, drop: Iterable[str] = DATE_PARTITIONS
) -> DataFrame:
    """Union by column name without the partition columns, which may differ in type."""
    return left.drop(*drop).unionByName(right.drop(*drop))


def concat_classes(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both classes, with a hash column that puts the rows in a repeatable mixed order."""
    rows = positives.unionByName(negatives)
    return rows.withColumn("mix_order", F.xxhash64(*sorted(rows.columns)))
