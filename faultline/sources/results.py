"""Reader of MTBF result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline import schemas
from faultline.functions.times import format_period, parse_period


def scan_results_json(spark: SparkSession, glob: str) -> DataFrame:
    """All result documents below a path or wildcard as rows.

    A document may be spread over lines; both spellings of the mtbf key are read.
    """
    documents = spark.read.text(glob, wholetext=True, recursiveFileLookup=True)
    return (
        documents.select(F.from_json("value", schemas.RESULT_DOCUMENT).alias("periods"))
        .select(F.explode("periods").alias("period", "hosts"))
        .select("period", F.explode("hosts").alias("host", "percentiles"))
        .select("period", "host", F.explode("percentiles").alias("percentile", "result"))
        .select(
            format_period(parse_period(F.col("period"))).alias("period"),
            "host",
            "percentile",
            "result.count_before",
            "result.count_after",
            F.coalesce(
                f"result.{fixed.RESULT_MTBF_KEY}", f"result.{fixed.RESULT_MTBF_KEY_ALTERNATIVE}"
            ).alias("mtbf_seconds"),
        )
    )
