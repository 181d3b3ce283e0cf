"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows and bytes of an Arrow batch: texts are long rows, and a worker and its
#: executor hold a batch at a time.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2000, 16 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application,
    and keep Arrow batches small (a smaller number of rows stays)."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_PER_BATCH:
        spark.conf.set(rows, ROWS_PER_BATCH)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BYTES_PER_BATCH}b")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="popweave-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/popweave", "zip", root.parent, root.name))
    _shipped.add(context.applicationId)
