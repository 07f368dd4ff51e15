import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import sharding


def check(rows, docs):
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (d.doc_id for d in docs)))
    texts = {d.doc_id: d.text or "" for d in docs}
    slots, where = {}, {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(raw, set()).add(r.shard)
    for s, own in slots.items():
        assert 0 <= s < 16 and sorted(own) == list(range(len(own)))
    return where


def test_query_on_a_table(spark, sf_small):
    rows = sharding.op8_sharding(spark, sf_small).collect()
    where = check(rows, spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    assert all(len(s) == 1 for s in where.values())
    loads = np.bincount([r.shard for r in rows], weights=[r["size"] for r in rows], minlength=16)
    biggest = max(r["size"] for r in rows)
    assert loads.max() - loads.min() <= max(biggest, 0.02 * loads.mean())


def test_query_on_odd_documents(spark, odd_docs, write_tables):
    check(sharding.op8_sharding(spark, write_tables(documents=odd_docs)).collect(), odd_docs.collect())


def test_a_group_too_large_for_a_shard_is_dealt_out(spark, write_tables):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" tail"))).alias("text"))
    rows = sharding.op8_sharding(spark, write_tables(documents=docs.repartition(4))).collect()
    where = check(rows, docs.collect())
    assert len(where[b"the same text"]) > 5
    loads = np.bincount([r.shard for r in rows], weights=[r["size"] for r in rows], minlength=16)
    assert loads.max() < 1.03 * loads.min()
    counts = np.bincount([r.shard for r in rows], minlength=16)
    assert counts.max() < 1.1 * counts.min()


def test_empty_table(spark, no_docs, write_tables):
    assert sharding.op8_sharding(spark, write_tables(documents=no_docs)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_place_balances_all_sizes(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.pareto(2, (2000, 3)) * 100 + 1
    sizes = np.floor(sizes)
    where = sharding.place(sizes, 16)
    for d in range(3):
        loads = np.bincount(where, weights=sizes[:, d], minlength=16)
        assert loads.max() < 1.2 * loads.min()
    first = np.bincount(where, weights=sizes[:, 0], minlength=16)
    assert first.max() - first.min() <= 0.005 * first.mean()


@pytest.mark.parametrize("seed", range(4))
def test_units_go_where_the_dot_product_is_highest(seed):
    """Every choice, replayed one unit and one shard at a time."""
    rng = np.random.default_rng(seed)
    sizes = (np.floor(rng.pareto(1.5, (300, 3)) * 64) + 1).tolist()
    out = sharding.assign(np.array(sizes), 8).tolist()
    totals = [sum(u[d] for u in sizes) / 8 for d in range(3)]
    parts = [[u[d] / totals[d] for d in range(3)] for u in sizes]
    left = [[1.0] * 3 for _ in range(8)]
    none = 0
    for u in sorted(range(300), key=lambda u: (-max(parts[u]), u)):
        able = [s for s in range(8) if all(left[s][d] >= parts[u][d] - 1e-12 for d in range(3))]
        none += not able
        worth = {s: sum(a * b for a, b in zip(left[s], parts[u])) for s in able} or {s: left[s][0] for s in range(8)}
        assert worth[out[u]] >= max(worth.values()) - 1e-9
        for d in range(3):
            left[out[u]][d] -= parts[u][d]
    assert none < 300


@pytest.mark.parametrize("seed", range(3))
def test_moves_only_narrow_the_first_size(seed):
    sizes = np.floor(np.random.default_rng(seed).pareto(1.5, (300, 3)) * 64) + 1
    spread = lambda out: np.ptp(np.bincount(out, weights=sizes[:, 0], minlength=8))
    before, after = sharding.assign(sizes, 8), sharding.place(sizes, 8)
    assert spread(after) <= spread(before) and (before == after).mean() > 0.3


def test_place_of_nothing_and_of_zeros():
    assert sharding.place(np.zeros((0, 3)), 16).tolist() == []
    assert set(sharding.place(np.zeros((5, 3)), 4).tolist()) <= set(range(4))


def test_clashing_columns(spark):
    df = spark.range(200).select(F.xxhash64("id").alias("group"), F.lit(3).cast("long").alias("n"), *[F.col("id").alias(c) for c in ("shard", "slot", "_task", "_nth", "_before", "_shard", "_of", "count", "unit", "large")])
    out = sharding.shard(df, "group", ["n"], 4)
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    assert sorted(r["_task"] for r in rows) == list(range(200))
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
