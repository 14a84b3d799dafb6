"""This package's code on the executors, for the few operators that run Python in tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fathom-code-")), "fathom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
