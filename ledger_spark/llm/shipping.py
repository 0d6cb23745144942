"""Readies a session for Python workers: sends this package to the executors once per application, and bounds Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Adaptive execution merges small shuffle partitions up to this size, and cuts skewed ones to it.
MERGED_BYTES = 16 << 20
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources as a zip file to the application; Spark copies it to every executor.

    Texts are long, so Arrow batches get `BATCH_ROWS` rows and `BATCH_BYTES` bytes (a longer row stands alone) unless the
    session asks for fewer: the memory of a batch stays with the executor once it was used.  For the same reason shuffle
    partitions are merged up to `MERGED_BYTES` only, where the session has Spark's own size for it.
    """
    context = spark.sparkContext
    if spark.conf.get(_MERGED).lower() in ("64mb", "64m", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(_MERGED, MERGED_BYTES)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    most = spark.conf.get(_BYTES).lower().removesuffix("b")  # a number of bytes unless the session spelled it with a unit
    if not most.lstrip("-").isdigit() or not 0 < int(most) <= BATCH_BYTES:
        spark.conf.set(_BYTES, BATCH_BYTES)
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ledger-spark-code-"), "ledger_spark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SENT.add(context.applicationId)
