"""Makes a session ready for code that runs in Python on the executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that Spark hands to Python at once; texts can be long.
BATCH = "500"
_sent: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, as ``--py-files`` does.

    The driver writes the archive to its own temporary folder and Spark serves it from there.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(), "faultline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; at its end, freed memory that Arrow and the C library keep goes to the system.

    A Python worker lives on after its task, and others may run beside it while it waits.
    """

    def to_the_end(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return to_the_end
