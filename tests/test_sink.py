"""A batch that fails and comes again counts once."""

import pytest
from pyspark.sql import functions as F

from thresher.operators import fragments as op
from thresher.sinks.batches import BatchSink
from thresher.sources.files import scan
from thresher.streaming.files import stream_fragments


def test_a_failed_and_repeated_batch_counts_once(spark, tmp_path):
    sink = BatchSink(spark, str(tmp_path / "out"))
    assert sink.read() is None and sink.done() == []
    assert sink.write(spark.range(3), 0)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sink.write(broken, 1)
    assert sink.done() == [0] and sorted(r.id for r in sink.read().collect()) == [0, 1, 2]
    assert sink.write(spark.range(10, 12), 1)
    assert not sink.write(spark.range(10, 12), 1) and not BatchSink(spark, str(tmp_path / "out")).write(spark.range(99), 0)
    assert sorted((r.batch, r.id) for r in sink.read().collect()) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11)]


def test_a_stream_of_functions(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    for k in range(4):
        (tree / f"f{k}.js").write_text(f"x = {{ m{k}() {{}} }};\n")
    sink = BatchSink(spark, str(tmp_path / "out"))
    for _ in range(2):  # the second time without the checkpoint, so that all batches come again
        query = stream_fragments(spark, str(tree), 2).writeStream.foreachBatch(lambda rows, n: sink.write(rows, n)).start()
        query.processAllAvailable()
        query.stop()
    want = op.fragments(op.eligible_files(scan(spark, str(tree)))).select("code").collect()
    assert sorted(r.code for r in sink.read().collect()) == sorted(r.code for r in want) and len(sink.done()) == 2
