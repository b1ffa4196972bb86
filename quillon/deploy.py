"""Getting this package to the Python workers of executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends the package to all executors of the session's context, once: workers can then import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillon-package-")
    archive = os.path.join(folder, "quillon.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("quillon", os.path.relpath(full, package)))
    context.addPyFile(archive)  # the driver's file server has it from now on
    context._quillon_shipped = True
