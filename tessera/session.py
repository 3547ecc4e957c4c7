"""The package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Rows that a Python worker gets at once where the session has Spark's own number; whole texts make rows large.
ROWS_A_BATCH, SPARKS_OWN = "2000", "10000"

_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it.

    The driver serves the archive from a folder that it removes when it ends. Batches of
    rows for Python are made smaller, unless the session has a number of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARKS_OWN:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    source = os.path.join(folder.name, "source", "tessera")
    shutil.copytree(os.path.join(root, "tessera"), source, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder.name, "tessera_package"), "zip", os.path.dirname(source)))
