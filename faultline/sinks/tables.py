"""Writers of partitioned Parquet tables.

Writing replaces only the partitions present in the data, so a job can be run again for
one day or month. Small results are regrouped before writing with the rebalance hint: it
groups rows by partition and splits a partition that is too large for one task, such as a
busy day. Typed logs are as large as the raw logs and already lie together by day, so
they are written by the tasks that read them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators.filters import is_memory_error
from faultline.schemas import MEMORY_ERROR_MARK, MEMORY_ERRORS
from faultline.session import shared_folder

DAY = ["year", "month", "day"]
FILE_BYTES = 128 << 20


def write_partitioned(
    table: DataFrame,
    path: str,
    partitions: Sequence[str],
    max_records_per_file: int = 0,
) -> None:
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partitions)
        .parquet(path)
    )


def sink_memory_errors(errors: DataFrame, path: str, by_host: bool = False) -> None:
    """Memory errors by day, with hosts in order inside the files.

    The number of files follows the bytes, not the hosts: a small day is one file, a large one is
    split. Statistics of row groups let a reader of one host skip the others. ``by_host`` gives
    every host of a day a folder of its own instead, for readers that expect that layout. A
    table has one layout; writing the other one into it is an error.
    """
    if lies_by_host(errors.sparkSession, path) not in (None, by_host):
        raise ValueError(f"{path} has the other layout; compact it, or write with by_host={not by_host}")
    rows = errors.select("timestamp", "msg", "host", *DAY)
    partitions = [*DAY, "host"] if by_host else DAY
    rows = rows.hint("rebalance", *partitions)
    if not by_host:
        rows = rows.sortWithinPartitions(*DAY, "host", "timestamp")
    write_partitioned(rows, path, partitions)


def lies_by_host(spark: SparkSession, path: str) -> bool | None:
    """Whether a table of memory errors has a folder for each host; None if there is no table."""
    try:
        table = spark.read.schema(MEMORY_ERRORS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    file = table.select("_metadata.file_path").first()
    return file and "/host=" in file[0]


def compact_memory_errors(spark: SparkSession, path: str, target_bytes: int = FILE_BYTES) -> int:
    """Rewrites the days that lie in more files than their bytes need; how many there were.

    Hosts of a day are packed, in order, into files of about ``target_bytes``; a host with more
    is split. A day is written aside and takes the place of its old files when the whole job has
    succeeded, and other days are not touched, so a job that fails or is run again does no harm.
    A table that lies by host is rewritten as a whole, with hosts inside the files.
    """
    by_host = lies_by_host(spark, path)
    if by_host is None:
        return 0
    table = spark.read.schema(MEMORY_ERRORS).parquet(path)
    file = F.col("_metadata.file_path")
    parts = written_table(
        table.groupBy(*DAY, "host", file.alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("size")
        ),
        "file-parts",
    )
    # A file's bytes are shared out by rows among the hosts in it.
    of_file = Window.partitionBy("file")
    parts = parts.withColumn("bytes", F.col("size") * F.col("rows") / F.sum("rows").over(of_file))
    days = parts.groupBy(*DAY).agg(F.count_distinct("file").alias("files"), F.sum("bytes").alias("bytes"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes))
    many = days.where((F.col("files") > needed) | F.lit(by_host)).select(*DAY)
    hosts = parts.join(many, DAY).groupBy(*DAY, "host").agg(F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy(*DAY).orderBy("host").rowsBetween(Window.unboundedPreceding, -1)
    hosts = hosts.withColumn(
        "bin", F.floor(F.coalesce(F.sum("bytes").over(earlier), F.lit(0.0)) / target_bytes)
    ).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)))
    bins = hosts.groupBy(*DAY, "bin").agg(F.max("pieces").alias("bin_pieces"))
    # Bins are far fewer than rows: one number for each file of the new table.
    so_far = Window.orderBy(*DAY, "bin")
    bins = bins.withColumn("first", F.sum("bin_pieces").over(so_far) - F.col("bin_pieces"))
    plan = written_table(hosts.join(bins, [*DAY, "bin"]).select(*DAY, "host", "pieces", "first"), "bins")
    changed, files = plan.agg(
        F.count_distinct(*DAY), F.max(F.col("first") + F.col("pieces"))
    ).first()
    if not changed:
        return 0
    same = F.col("host").eqNullSafe(F.col("_host"))
    for name in DAY:
        same &= F.col(name) == F.col(f"_{name}")
    wanted = plan.withColumnsRenamed({name: f"_{name}" for name in [*DAY, "host"]})
    piece = F.pmod(F.xxhash64("timestamp", "msg"), F.col("pieces"))
    rows = table.join(wanted, same).withColumn("_file", (F.col("first") + piece).cast("int"))
    rows = rows.repartitionById(int(files), F.col("_file")).sortWithinPartitions(*DAY, "host", "timestamp")
    write_partitioned(rows.select("timestamp", "msg", "host", *DAY), path, DAY)
    return changed


def sink_typed_logs(
    logs: DataFrame,
    path: str,
    tasks: int | None = None,
    max_records_per_file: int = 0,
    mark_errors: bool = True,
) -> None:
    """Typed logs by day. ``tasks`` limits the write tasks, which only suits small input.

    Messages are classed once, here: a column tells memory errors, and files hold them
    together, by host, so that ``filter_memory_errors`` skips the row groups of all other
    messages. Rows are sorted in the tasks that read them.
    """
    if tasks:
        logs = logs.coalesce(tasks)
    if mark_errors and {"msg", "host"} <= set(logs.columns):
        marked = logs.withColumn(MEMORY_ERROR_MARK, F.coalesce(is_memory_error(), F.lit(False)))
        logs = marked.sortWithinPartitions(*DAY, F.desc(MEMORY_ERROR_MARK), "host")
    write_partitioned(logs, path, DAY, max_records_per_file)


def sink_features_month(features: DataFrame, path: str, files: int | None = None) -> None:
    """Feature rows by month; ``files`` asks for that many files instead of Spark's choice."""
    partitions = ["year", "month"]
    if files:
        features = features.repartition(files)
    else:
        features = features.hint("rebalance", *partitions)
    write_partitioned(features, path, partitions)


def written_table(table: DataFrame, name: str) -> DataFrame:
    """The table, stored at once in the shared folder and read back.

    The write is a job that runs when this is called. ``session.work_tables`` deletes such
    tables when the job that uses them is over.

    For a small table that several later steps use: its input is then read once, and a
    lost executor costs a read of files instead of a recomputation.
    """
    spark: SparkSession = table.sparkSession
    path = shared_folder(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
