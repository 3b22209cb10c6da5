"""Gives the executors this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package as a py-file, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path
