"""The stored vector index: exact lookups, recall of few probes, files that are read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.operators import similarity as sim
from thresher.operators.vectorindex import VectorIndex


def clustered(rng, n, groups=30, dim=16):
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, dim))
    return [(k, [float(v) for v in row]) for k, row in enumerate(x)]


def rows(df):
    return sorted(map(tuple, df.select("query_id", "neighbor_id", "similarity", "rank").collect()))


def test_exact_lookup_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = clustered(rng, 300, 8, 6) + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(40)]
    data += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [math.nan] * 6), (2004, [1.0, None]), (2005, [2.0]), (None, [1.0] * 6), (2006, [1.0, 1.0]), (7, data[7][1])]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(3).withColumn("cell", F.lit("mine"))
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "index"), cells=10, sample=200)
    asked = df.where("id % 7 = 0 or id >= 2000")
    want = rows(sim.cosine_top_k(asked, df, "id", "v", 6))
    assert rows(index.lookup(asked, "id", "v", 6)) == want
    near = [r for r in rows(sim.cosine_top_k(asked, df, "id", "v", 6)) if r[2] >= 0.95]
    assert rows(VectorIndex(spark, str(tmp_path / "index")).lookup(asked, "id", "v", 6, least=0.95)) == near and near


def test_recall_and_files_of_few_probes(spark, tmp_path):
    df = spark.createDataFrame(clustered(np.random.default_rng(3), 3000), "id long, v array<double>").repartition(4)
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "index"), cells=32, sample=500)
    asked = df.where("id % 50 = 0")
    want = {(q, n) for q, n, _, _ in rows(sim.cosine_top_k(asked, df, "id", "v", 10))}
    got = {(q, n) for q, n, _, _ in rows(index.lookup(asked, "id", "v", 10, probes=3))}
    assert len(got & want) >= 0.9 * len(want)
    files = lambda cells: index.blocks(cells).select("_metadata.file_path").distinct().count()
    assert 0 < files([0, 1, 2]) < files(list(range(32))) / 5
    assert "PartitionFilters: [isnotnull(cell" in index.blocks([3])._jdf.queryExecution().toString() or "PartitionFilters: [cell" in index.blocks([3])._jdf.queryExecution().toString()
    held = index.blocks(list(range(32))).select(F.sum(F.size("ids"))).first()[0]
    assert held == 3000


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, [0.0, 0.0])]])
def test_index_of_nothing(spark, tmp_path, data):
    df = spark.createDataFrame(data, "id long, v array<double>")
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "none"))
    assert index.lookup(df, "id", "v", 3).collect() == [] == index.lookup(spark.createDataFrame([(5, [1.0, 2.0])], df.schema), "id", "v", 3).collect()
