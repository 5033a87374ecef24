"""The package's code on executors that don't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to what executors import from, once a session."""
    context = spark.sparkContext
    if not getattr(context, "_locusframe_shipped", False):
        root = Path(__file__).resolve().parent
        at = tempfile.mkdtemp()  # the driver serves it to executors as long as it lives
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{at}/locusframe", "zip", root.parent, root.name))
        context._locusframe_shipped = True
