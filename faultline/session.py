"""Session settings and the folder for tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


# Times are read and bucketed in UTC, so daylight-saving changes cannot merge hours. As
# plain numbers in files, timestamps have statistics that let a scan skip files.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(app_name: str = "faultline", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` adds or overrides.

    Adaptive execution sizes shuffle partitions and splits skewed ones at run time, so
    no partition count is fixed here.
    """
    settings = {
        **REQUIRED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_settings(spark: SparkSession) -> None:
    """Sets what results and scans depend on in a session that was made elsewhere."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


def require_utc(spark: SparkSession) -> None:
    """Raises in a session whose hours and months are not those of UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the job needs spark.sql.session.timeZone UTC, the session has {zone}")


_open_folders: ContextVar[list[str] | None] = ContextVar("open_folders", default=None)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that jobs store for themselves inside are deleted at the end.

    Results of these jobs must be written or collected inside, as they read those tables.
    """
    folders: list[str] = []
    token = _open_folders.set(folders)
    try:
        yield
    finally:
        _open_folders.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the folder that every executor can reach.

    That folder is ``spark.checkpoint.dir``. Only a local session may go without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="faultline-")
    path = f"{root.rstrip('/')}/faultline/{name}-{uuid.uuid4().hex}"
    folders = _open_folders.get()
    if folders is not None:
        folders.append(path)
    return path
