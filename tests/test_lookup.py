"""Batches and lookup against plain versions, on rows that are easy to get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.operators import similarity as sim
from thresher.plans import pipeline as pl


@pytest.mark.parametrize("keys", [[], [None, None], list(range(500)), [2**62 - k * 10**15 for k in range(400)], [7] * 300, [None] * 100 + [5] * 200 + list(range(60)) + [9] * 90])
def test_batches_follow_the_key(spark, keys):
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "id long, other long").repartition(3)
    got = pl.batch_numbers(rows, "id", size=7).collect()
    assert sorted(r.batch for r in got) == [n // 7 for n in range(len(keys))]
    assert sorted((str(r.id), r.other) for r in got) == sorted((str(k), n) for n, k in enumerate(keys))
    last = -math.inf
    for batch in range(len(keys) // 7 + 1):
        mine = [-math.inf if r.id is None else r.id for r in got if r.batch == batch]
        assert not mine or min(mine) >= last
        last = max(mine, default=last)


def test_batches_of_many_strings(spark):
    """A string key, more rows than one part of the former method took, a key that a third of all rows share."""
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, F.lit("app/same.js")).otherwise(F.concat(F.lit("app/"), F.sha2(F.col("id").cast("string"), 256))).alias("path"), (F.col("id") % 11).alias("length"), F.lit("x").alias("_part"))
    got = pl.numbered(rows, "path", "length").toPandas().sort_values("number")
    assert got["number"].tolist() == list(range(90_000)) and got["path"].is_monotonic_increasing
    assert (got["before"].to_numpy() == np.cumsum(got["length"].to_numpy()) - got["length"].to_numpy()).all()
    sizes = pl.numbered(rows, "path").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 60_000


def test_tasks_of_equal_bytes(spark):
    """One file as large as a tenth of all bytes beside thousands of small ones."""
    rows = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 17, 100_000).when(F.col("id") == 18, None).otherwise(200).cast("long").alias("length"))
    out = pl.by_bytes(rows, "path", "length", 16)
    each = out.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).collect()
    share = (4998 * 200 + 100_000) / 16
    assert len(each) == 16 and sum(r.n for r in each) == 5000
    assert all(r.bytes <= share + 100_000 for r in each) and sorted(r.bytes for r in each)[-2] <= share + 400


def plain_top(queries, rows, k):
    def cosine(a, b):
        n = max(len(a), len(b))
        a, b = np.array([*a, *[0] * (n - len(a))]), np.array([*b, *[0] * (n - len(b))])
        return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6) + 0.0

    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in good:
        if i in queries:
            found = sorted((-cosine(v, w), j) for j, w in good if j != i)[:k]
            out += [(i, j, -s + 0.0, n) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8, 4096])
def test_cosine_of_odd_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 5)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(25)]  # ties
    rows += [(200, None), (201, []), (202, [0.0] * 5), (203, [math.nan] * 5), (204, [1.0, None, 0.0, 0.0, 0.0]), (205, [math.inf] * 5), (206, [2.0]), (None, [1.0] * 5), (207, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = {i for i, _ in rows if i is not None and i % 5 == 0} | {201, 202, 203, 206}
    got = sim.cosine_top_k(df.where(F.col("id").isin(*queries)), df, "id", "v", 6, block)
    assert sorted((r.query_id, r.neighbor_id, r.similarity, r["rank"]) for r in got.collect()) == plain_top(queries, [r for r in rows if r[0] != 207], 6)


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<float>")
    assert sim.cosine_top_k(df, df, "id", "v", 3).collect() == []


def test_embedding_of_short_and_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "abc"), (5, "aé😀b")], "id long, t string")
    got = {r.id: r.v for r in df.select("id", sim.embed(F.col("t")).alias("v")).collect()}
    assert all(len(v) == sim.DIMENSION for v in got.values())
    assert not any(got[1] + got[2] + got[3]) and max(got[4]) == 1.0
    codes = [ord(c) for c in "aé😀b"]
    bins = {(codes[k] * 1009**2 + codes[k + 1] * 1009 + codes[k + 2]) % 64 for k in range(2)}
    assert {k for k, x in enumerate(got[5]) if x} == bins


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1, "function a(){return 1}"), (2, "function a(){return 2}"), (3, "entirely(else)")], "id long, form string")
    assert [(r.query_id, r.neighbor_id) for r in sim.near_duplicates(df, "form", "id", 0.8).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
