"""The package on the executors' Python path."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows in an Arrow batch, where the session leaves Spark's default of 10,000: rows here hold whole texts, and an executor's
#: memory holds a batch several times, on the JVM's side and the worker's.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable by Python workers, once for each Spark context; Spark's file server sends it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_galley_shipped", None) != context.applicationId:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="galley-package-")) / "galley.zip"
        with zipfile.ZipFile(path, "w") as file:
            for source in sorted(root.rglob("*.py")):
                file.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
        context._galley_shipped = context.applicationId
    return spark


def release() -> None:
    """Give memory that this process has freed back to the system; its allocators would keep it for the next task."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def trimmed(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInPandas function that gives memory back at the end of its task, as executors keep their Python workers."""

    def run(frames: Iterator) -> Iterator:
        try:
            yield from batches(frames)
        finally:
            release()

    return run
