"""Sending the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, also where it is not installed. Once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_winnowlake_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="winnowlake-"), "winnowlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("winnowlake", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._winnowlake_shipped = True
    return spark
