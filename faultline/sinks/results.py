"""Writers of results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.times import parse_period


HOSTS_PER_DOCUMENT = 500


def result_documents(
    results: DataFrame, hosts_per_document: int = HOSTS_PER_DOCUMENT
) -> DataFrame:
    """MTBF rows as JSON documents of nested maps, one per period and part of its hosts.

    The hosts of a period are cut by rank into documents of ``hosts_per_document``; a reader merges
    them. One pass: nothing is counted before, so a lazy job behind ``results`` runs once.
    """
    value = F.struct(
        "count_before", "count_after", F.col("mtbf_seconds").alias(fixed.RESULT_MTBF_KEY)
    )
    first_day = parse_period(F.col("period"))
    host = F.coalesce("host", F.lit("null"))
    by_host = results.groupBy(
        F.concat(F.year(first_day), F.month(first_day)).alias("period"), host.alias("host")
    ).agg(F.map_from_entries(F.collect_list(F.struct("percentile", value))).alias("percentiles"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy("host")) - 1
    by_part = by_host.withColumn("part", F.floor(rank / hosts_per_document)).groupBy("period", "part")
    hosts = F.map_from_entries(F.collect_list(F.struct("host", "percentiles")))
    document = F.to_json(F.create_map("period", "hosts"), {"ignoreNullFields": "false"})
    return by_part.agg(hosts.alias("hosts")).select("period", "part", document.alias("value"))


def sink_results_json(
    results: DataFrame, path: str, hosts_per_document: int = HOSTS_PER_DOCUMENT
) -> None:
    """One folder per period, one document per file; the periods written are replaced."""
    (
        result_documents(results, hosts_per_document)
        .select("value", "period")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 1)
        .partitionBy("period")
        .text(path)
    )


def sink_to_driver(table: DataFrame, max_rows: int = 1_000_000) -> pd.DataFrame:
    """A report as a whole; an error if it has more than ``max_rows`` rows."""
    rows = table.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"the table has more than {max_rows} rows; write it to a table instead")
    return rows
