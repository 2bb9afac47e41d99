"""Sends this package to executors, whose Python workers import it by name."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's modules as a zip file that Spark hands to every executor, also to those that join later."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "ledgerloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    f = os.path.join(at, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
