"""Files from any store that Spark reads."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.functions.eligibility import MAX_BYTES


def scan(spark: SparkSession, path: str | list[str], pattern: str = "*.js", recursive: bool = True) -> DataFrame:
    """path, length and content of each file below `path` whose name fits `pattern`.

    A size condition on `length` reaches the scan, and content is not read
    where it isn't asked for. Spark's scan passes over files without a byte.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", "content")


def relative(files: DataFrame, root: str) -> DataFrame:
    """`files` with paths relative to `root`, as a repository names them."""
    prefix = root.rstrip("/") + "/"
    bare = F.regexp_replace("path", r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "")
    return files.withColumn("path", F.when(bare.startswith(prefix), F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))).otherwise(bare))


def read_listed(spark: SparkSession, paths: Iterable[str], root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of a list of paths relative to `root`; what is not there any more is left out.

    The list is one of changed files and so is small. The driver reads them,
    since executors may not see its work tree; files above `max_bytes`, which
    no rule lets pass, keep their length and lose their content.
    """
    rows = []
    for path in paths:
        full = os.path.join(root, path)
        if path and os.path.isfile(full):
            size = os.path.getsize(full)
            content = b""
            if size <= max_bytes:
                with open(full, "rb") as f:
                    content = f.read()
            rows.append((path, size, bytearray(content)))
    return spark.createDataFrame(rows, "path string, length long, content binary")
