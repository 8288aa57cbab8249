"""What a session needs before Python workers run this package's functions."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a context, so that it need not be installed there."""
    context = spark.sparkContext
    if not getattr(context, "_tidewater_shipped", False):
        top = Path(__file__).resolve().parents[1]
        context._tidewater_folder = tempfile.TemporaryDirectory()  # the driver serves the file as long as the context lives
        context.addPyFile(shutil.make_archive(os.path.join(context._tidewater_folder.name, "tidewater"), "zip", top, "tidewater"))
        context._tidewater_shipped = True
    return spark
