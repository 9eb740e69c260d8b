"""Train and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.operators.filters import filter_class
from faultline.operators.ordering import first_rows

LABEL = "label_next_hour"


def temporal_split(
    prepared: DataFrame, train_fraction: float = fixed.TRAIN_FRACTION
) -> DataFrame:
    """Adds ``split``: the first share of the rows in time order is train, the rest test.

    The share is an exact number of rows, cut off; rows of one window are ordered by host.
    """
    marked = first_rows(
        prepared, "feature_window_start", ["host"], F.col("total") * F.lit(train_fraction)
    )
    return marked.withColumn("split", F.when(F.col("is_first"), "train").otherwise("test")).drop(
        "is_first"
    )


def downsample_negatives(
    train: DataFrame,
    fraction: float = fixed.NEGATIVE_FRACTION,
    seed: int = fixed.SEED,
    label: str = LABEL,
) -> DataFrame:
    """All positives and exactly ``round(negatives * fraction)`` negatives.

    The negatives with the smallest hash of seed, window and host are taken. That is as
    good as random, and the same rows come out however the data is partitioned.
    """
    hashed = filter_class(train, label, 0).withColumn(
        "_hash",
        F.md5(
            F.concat_ws(
                "|", F.lit(str(seed)), F.unix_seconds("feature_window_start"), F.col("host")
            )
        ),
    )
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, 4))
    chosen = first_rows(
        bucketed, "_bucket", ["_hash"], F.bround(F.col("total") * F.lit(fraction))
    ).where("is_first")
    return filter_class(train, label, 1).unionByName(chosen.select(*train.columns))
