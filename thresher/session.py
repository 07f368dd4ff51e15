"""Session helper for local runs, tests and the command line."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session in UTC with adaptive execution on.

    On a cluster the caller brings its own session; nothing in this package
    needs settings beyond Spark's defaults.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("thresher")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, where they would not find it by themselves."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    paths = [os.getcwd(), *(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in map(os.path.abspath, paths):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="thresher-"), "thresher.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
