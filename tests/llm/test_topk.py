import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, is_query):
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for q, qv in dict(sorted(((i, v) for i, v in good if is_query(i)), reverse=True)).items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 4 == 0, k=k).collect())


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [1.0] * 6) for i in range(80)]  # one vector many times
    rows += [(400, None), (401, [1.0, None, 2.0]), (404, [float("nan")] * 6), (408, [float("inf")] * 6), (412, []), (413, [3.0]), (None, [1.0] * 6), (5, [9.0] * 6)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 4 == 0)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (4, [0.0, 0.0])]
    assert run(spark, rows, 20) == brute(rows, 20, lambda i: i % 4 == 0)


def test_values_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [0.0, 1.0])]
    assert [(r[2], r[3]) for r in run(spark, rows)] == [(1, 2**63 - 1), (3, 4096), (2, -(2**63))]


def clamped(rows, k, is_query):
    scaled = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    out = []
    for q, qv in scaled:
        if is_query(q):
            scores = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(qv, v)))), i) for i, v in scaled if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [3e38, -3e38, 1e36, 1e19, 1e8])
@pytest.mark.parametrize("at", [7, 8])
def test_one_very_large_row_among_many(spark, size, at):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows[at] = (at, [size, *rows[at][1][1:]])
    assert run(spark, rows) == clamped(rows, 5, lambda i: i % 4 == 0)


def test_ties_at_the_low_end_go_to_the_smaller_id(spark):
    rows = [(0, [1e30])] + [(i, [-1e30 * (13 - i)]) for i in range(1, 13)]
    assert run(spark, rows) == clamped(rows, 5, lambda i: i % 4 == 0)


def test_distances_beyond_any_float_prune_nothing():
    x = np.floor(np.random.default_rng(4).normal(0, 64, (300, 4)))
    x[9] = 1e200
    pivots = topk.choose_pivots(x)
    far, norms = topk.distances(x, pivots), (x * x).sum(axis=1)
    ids, scores, _ = topk.search(x[17], 17, -np.inf, far[17], np.arange(len(x)), x, norms, topk.margins(far, 4), 10)
    exact = sorted((-min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(v, x[17])))), i) for i, v in enumerate(x) if i != 17)[:10]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == exact


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bound_order_stops_early():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (20, 16))
    x = np.floor(np.concatenate([c + rng.normal(0, 2, (200, 16)) for c in centres]))
    pivots = topk.choose_pivots(x)
    far, norms = topk.distances(x, pivots).astype(np.float32), (x * x).sum(axis=1)
    q = x[17]
    ids, scores, seen = topk.search(q, 17, -np.inf, far[17], np.arange(len(x)), x, norms, topk.margins(far, 16), 10)
    exact = sorted((-int(v), i) for i, v in enumerate(x @ q) if i != 17)[:10]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == exact
    assert seen < len(x) / 2


def test_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_small}/embeddings.parquet'")
    got = topk.op10_topk(spark, sf_small).toArrow()
    want = con.sql(topk.OP10_SQL).to_arrow_table().select(got.column_names)
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist()))


@pytest.mark.parametrize("n", [0, 1, 40])
def test_pivots_differ(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    p = topk.choose_pivots(x, 8)
    assert len(p) == min(8, n) and len(np.unique(p, axis=0)) == len(p)


def test_clashing_columns(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("query_id", "rank", "score", "group", "task", "part", "ids", "floors", "asks"):
        df = df.withColumn(name, F.lit("old"))
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 4 == 0, k=5).collect()) == brute(rows, 5, lambda i: i % 4 == 0)


def test_many_blocks_of_clusters(spark, monkeypatch):
    """Small blocks of clustered vectors: many pairs of blocks need not meet, and nothing is lost."""
    monkeypatch.setattr(topk, "CANDIDATES", 32)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3, (12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.05, 6)]) for i in range(900)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 4 == 0)


def test_block_bound_is_over_every_product():
    rng = np.random.default_rng(9)
    for scale in (1.0, 64.0, 1e9):
        x, q = np.floor(rng.normal(0, scale, (40, 5))), np.floor(rng.normal(0, scale, (30, 5)) + 3 * scale)
        pivots = topk.choose_pivots(x, 4)
        far, q_far = topk.distances(x, pivots), topk.distances(q, pivots)
        bound = topk.block_bound(float((x * x).sum(axis=1).max()), far.min(axis=0), far.max(axis=0), float((q * q).sum(axis=1).max()), q_far.min(axis=0), q_far.max(axis=0), 5)
        assert bound >= (x @ q.T).max()


def test_the_session_keeps_its_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    run(spark, [(0, [1.0, 2.0]), (1, [0.5, -1.0])])
    assert spark.conf.get(key) == before
