"""Sends the library to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of this package to the session's application, once, so that workers can import it
    wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tidewave-"), "tidewave.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(top.rglob("*.py")):
                out.write(f, f"{top.name}/{f.relative_to(top)}")
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark
