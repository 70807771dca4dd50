"""Send this package's source to the executors of a session, as spark-submit --py-files would."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark application: executors can then import the package wherever the driver runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="treefold-source-")
    atexit.register(shutil.rmtree, folder, True)  # Spark serves the file from here while it runs
    path = os.path.join(folder, "treefold_source.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in sorted(os.walk(home)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
