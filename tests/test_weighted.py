"""The fitted embedding against a plain version."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from thresher.operators.weighted import WeightedEmbedding, bins, bins_in_batches
from thresher.scratch import stored


def plain_bins(text, dimension=32, gram=3):
    return [int(hashlib.md5(text[i : i + gram].encode()).hexdigest()[:8], 16) % dimension for i in range(len(text or "") - gram + 1)]


ROWS = [(1, "function(){return 1}"), (2, "function(){return 2}"), (3, None), (4, ""), (5, "ab"), (6, "aé😀b漢"), (7, "aaaaaaaa"), (None, "function")]


def test_weights_and_vectors(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, form string").repartition(3)
    WeightedEmbedding.fit(df, "form", str(tmp_path / "model"), 32, 3)
    model = WeightedEmbedding(spark, str(tmp_path / "model"))
    held = Counter(b for _, t in ROWS for b in set(plain_bins(t)))
    weight = lambda b: math.log((1 + len(ROWS)) / (1 + held[b])) + 1
    asked = [(1, ROWS[0][1]), (9, "something else"), (3, None), (None, "function")]
    got = {(r.id, r.bin): r.value for r in model.embed(spark.createDataFrame(asked, df.schema), "form", "id").collect()}
    want = {}
    for key, text in asked[:2]:
        values = {b: n * weight(b) for b, n in Counter(plain_bins(text)).items()}
        size = math.sqrt(sum(v * v for v in values.values()))
        want |= {(key, b): v / size for b, v in values.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_worker_of_python(spark, tmp_path):
    df = spark.createDataFrame([], "id long, form string")
    model = WeightedEmbedding.fit(df, "form", str(tmp_path / "none"))
    out = model.embed(df, "form", "id")
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_of_one_key_count_as_one_text_and_others_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, form string")
    model = WeightedEmbedding.fit(df, "form", str(tmp_path / "model"), 32, 3)
    weight = {r.bin: r.weight for r in model.weights.collect()}
    asked = [(1, "aaaaaaaa"), (1, ROWS[0][1]), (2, ROWS[0][1]), (2, None), (3, "return 1return 2"), (4, "ab")]
    got = {(r.id, r.bin): r.value for r in model.embed(spark.createDataFrame(asked, df.schema), "form", "id").collect()}
    want = {}
    for key in (1, 2, 3):
        values = {b: n * weight.get(b, math.log(1 + len(ROWS)) + 1) for b, n in Counter(b for k, t in asked if k == key for b in plain_bins(t)).items()}
        size = math.sqrt(sum(v * v for v in values.values()))
        want |= {(key, b): v / size for b, v in values.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    single = model.embed(spark.createDataFrame(asked[-2:], df.schema), "form", "id")
    assert "hashpartitioning" not in single._jdf.queryExecution().executedPlan().toString()


def test_stored_bins_stand_for_texts_and_no_row_carries_the_weights(spark, tmp_path):
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None], "id long, form string").repartition(3)
    for dimension in (32, 1000, 1024):
        binned = stored(df.select("id", bins(F.col("form"), dimension, 3).alias("bins")), "bins")
        assert {r.id: list(r.bins) for r in binned.collect()} == {k: plain_bins(t, dimension) for k, t in df.collect()}
        by_text = WeightedEmbedding.fit(df, "form", str(tmp_path / f"text{dimension}"), dimension, 3)
        by_bins = WeightedEmbedding.fit(binned, "bins", str(tmp_path / f"bins{dimension}"), dimension, 3)
        out = by_bins.embed(binned, "bins", "id")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, by_text.embed(df, "form", "id").collect())) != []
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_bins_of_python_workers_are_the_same(spark):
    df = spark.createDataFrame(ROWS, "id long, form string").repartition(2)
    for dimension, gram in ((1024, 4), (1000, 3)):
        rows = df.select(bins(F.col("form"), dimension, gram).alias("a"), bins_in_batches(F.col("form"), dimension, gram).alias("b")).collect()
        assert len(rows) == len(ROWS) and all(r.a == r.b for r in rows)
