"""Give a session's executors this package, once, so that functions which run in Python workers can import it there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Serve a zip of the package's modules to the executors through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quern-")), "quern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quern", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._quern_shipped = True


def shipped(query):
    """query(spark, ...) after ship(spark)."""

    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
