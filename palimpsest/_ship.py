"""Sends this package to the Python workers, so that functions which run there can be imported."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


#: Rows in a batch for Python workers where the session has Spark's default: rows here are whole texts.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Does nothing if the workers find the package on PYTHONPATH; else adds it as a zip, once for each application. Sees that batches for workers stay small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    here = Path(__file__).resolve().parent
    at = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(here.parent) in at or app in _sent:
        return
    _sent.add(app)
    d = tempfile.mkdtemp(prefix="palimpsest-zip-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)  # workers fetch it from the driver as they start
    with zipfile.ZipFile(to := f"{d}/{here.name}.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(to)
