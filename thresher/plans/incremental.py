"""The analysis over a tree that is looked at again and again: only contents that are new are parsed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from thresher.functions.eligibility import DEFAULT, Rules
from thresher.operators import fragments as op
from thresher.scratch import spread_join, stored

#: Part of the key of what was parsed; another number makes all files new.
VERSION = 1

_STATE = "digest string, fragments array<struct<code:string,start:int,end:int,processedCode:string>>"


def _parsed(found: DataFrame, state: str) -> DataFrame:
    """What the state holds, one row for each digest; nothing where there is no state yet."""
    spark = found.sparkSession
    try:
        # runs that overlapped may both have added a content
        return spark.read.schema(_STATE).parquet(state).dropDuplicates(["digest"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE)


def analyse_again(found: DataFrame, state: str, folders: Iterable[str] = (), rules: Rules = DEFAULT, observation: Observation | None = None) -> DataFrame:
    """Chunks (path, fragments) of the eligible files of a scan, as `analyse` gives them.

    `state`: a folder of any store, to which each run adds what it has parsed
    under the digest of the content, so that a file that was moved or copied
    isn't parsed again either. A run that fails adds nothing or leaves out
    what the next one then parses. An observation gets `parsed`, the number
    of contents that were new. Files that are not text have no functions.
    """
    digest = F.when(F.col("text").isNotNull(), F.concat(F.lit(f"{VERSION}:"), F.sha2("text", 256)))
    files_ = op.eligible_files(found, folders, rules).select("path", digest.alias("digest"), "text")
    new = files_.where("digest is not null").join(_parsed(found, state).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    if observation is not None:
        new = new.observe(observation, F.count("*").alias("parsed"))
    op.chunks(new, "digest").withColumnRenamed("path", "digest").write.mode("append").parquet(state)
    named = stored(files_.select("path", "digest"), "named")
    known = spread_join(named.where("digest is not null"), _parsed(found, state), "digest").select("path", "fragments")
    return known.unionByName(named.where("digest is null").select("path", F.array().cast("array<struct<code:string,start:int,end:int,processedCode:string>>").alias("fragments")))
