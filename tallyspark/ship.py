"""Sends this package to the executors' Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: Spark serves a zip of the package to its executors."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-code-"), "tallyspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
