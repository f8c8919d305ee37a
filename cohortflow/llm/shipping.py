"""Sends the package to Python workers that would not find it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Add the package as a Python file of the application, unless workers get its folder by PYTHONPATH or working folder."""
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if ROOT in map(os.path.abspath, filter(None, seen)) or any("cohortflow-package" in f for f in context.listFiles):
        return
    folder = tempfile.mkdtemp()  # the driver serves the file; executors fetch it
    context.addPyFile(shutil.make_archive(os.path.join(folder, "cohortflow-package"), "zip", ROOT, "cohortflow"))

