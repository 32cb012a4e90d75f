"""This package's code on the executors, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to all Python workers of the application, once; Spark serves the archive to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    context.addPyFile(path)
    # long texts and packed rows: a worker gets at most so many rows and bytes at a time, so its memory is bounded
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        try:
            now = int(spark.conf.get(key).rstrip("bB"))
        except Exception:  # not a setting of this Spark
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    _shipped.add(context.applicationId)
