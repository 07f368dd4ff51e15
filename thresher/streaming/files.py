"""The analysis over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thresher.operators import fragments as op
from thresher.sources.changes import stream_changes
from thresher.sources.files import relative

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_fragments(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of functions of the eligible `.js` files that appear below `root`; stateless, so append only."""
    arriving = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("pathGlobFilter", "*.js")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .load(root)
    )
    return op.fragments(op.eligible_files(relative(arriving, root).select("path", "length", "content")))


def stream_commits(spark: SparkSession, cwd: str, **options) -> DataFrame:
    """A stream of functions of the eligible files that commits of a repository add or change; options as for `GitChanges`."""
    return op.fragments(op.eligible_files(stream_changes(spark, cwd=cwd, **options)))
