"""Scratch tables: where they lie, and what is left of them."""

import os

import pytest
from pyspark.sql import functions as F

from thresher.llm import _common, jaccard, sharding


def test_operators_leave_only_what_their_result_reads(spark):
    _common.release_scratch(spark)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g "), (F.col("id") % 50).cast("string")).alias("text"))
    out = jaccard.jaccard_join(docs)
    assert len(_common.written()) == 2 and out.count() == 300
    sharding.shard(docs.select(F.xxhash64("text").alias("group"), F.lit(1).cast("long").alias("n")), "group", ["n"]).count()
    paths = _common.written()
    assert len(paths) == 3 and all(os.path.isdir(p.removeprefix("file:")) for p in paths)
    _common.release_scratch(spark)
    assert not _common.written() and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError):
        _common.scratch_root(Session())
    Context.master = "local[2]"
    Context.setCheckpointDir = lambda self, path: None
    assert os.path.isdir(_common.scratch_root(Session()))


def test_fresh_names(spark):
    df = spark.range(1).withColumn("_Task", F.lit(1)).withColumn("_task_", F.lit(1))
    assert _common.fresh(df, "_task", "n") == ["_task__", "n"]
