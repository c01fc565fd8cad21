"""Make the package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="beaconry-package-")
    archive = shutil.make_archive(f"{folder}/beaconry", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _DONE.add(app)
