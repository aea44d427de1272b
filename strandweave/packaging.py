"""Ships the package to Python workers that cannot import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once, unless PYTHONPATH already leads workers to it."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    on_path = any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp()  # the driver serves the file from here while the session lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/strandweave", "zip", root, "strandweave"))
    _shipped.add(context.applicationId)
