import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import veccodes


def brute(rows, entries=256, rounds=4, parts=4):
    """Codes, errors and label errors by scans of all entries, in Python's integers."""
    kept = [(k, [math.floor(1024 * x) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(k, v + [0] * (dim - len(v)), g) for k, v, g in kept]
    least = {}
    for k, v, _ in kept:
        least[k] = min(least.get(k, v), v)
    first = [least[k] for k in sorted(least, key=lambda k: (k is None, k))[:entries]]
    wide = dim // parts
    cut = lambda v, p: np.array(v[p * wide : (p + 1) * wide], dtype=object)
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def assign():
        found = []
        for _, v, _ in kept:
            each = []
            for p in range(parts):
                d = ((np.array(books[p]) - cut(v, p)) ** 2).sum(axis=1).tolist() if wide else [0] * len(books[p])
                each.append((d.index(min(d)), min(d)))
            found.append(each)
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(first)):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][0] == e]
                if own:
                    books[p][e] = sum(own) // len(own)
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    total = {}
    for (_, _, g), e in zip(kept, errors):
        total[g] = total.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((k, "".join(f"{i:02x}" for i, _ in f), e, total[g], digest) for (k, _, g), f, e in zip(kept, found, errors)), key=str)


def result(rows, spark, write_tables, partitions=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(partitions)
    out = veccodes.op13_vector_codes(spark, write_tables(embeddings=df))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_heaps_give_what_full_scans_give():
    rng = np.random.default_rng(3)
    for dim, count in ((1, 300), (3, 500), (8, 400)):
        x = rng.integers(-40, 40, (count, dim)).astype(float)
        books = veccodes.Codebooks(np.tile(x[:20], (1, 4)), 4)
        heap = veccodes.Heaps(count, 20)
        scanned = []
        for turn in range(12):
            rows, was, now = heap.turn(x, books.entries[0], books.limits[0])
            scanned.append(len(rows))
            d = ((x[:, None, :] - books.entries[0][None]) ** 2).sum(axis=2)
            assert (heap.codes == d.argmin(axis=1)).all()
            assert all((np.diff(heap.keys[a:b]) >= 0).all() for a, b in zip(heap.starts[:-1], heap.starts[1:]))
            n, sums = veccodes.moved(x[rows], was, now, 20, turn == 0)
            books.n[0] += n
            books.sums[0] += sums
            assert all((books.sums[0][e] == x[heap.codes == e].sum(axis=0)).all() and books.n[0][e] == (heap.codes == e).sum() for e in range(20))
            books.update()
        assert scanned[0] == count and min(scanned) < count / 2


def test_matches_brute_force(spark, write_tables):
    rng = np.random.default_rng(5)
    rows = [(int(k) * 3, [float(v) for v in rng.normal(size=8)], int(k) % 3) for k in range(420)]
    assert result(rows, spark, write_tables) == brute(rows)


def test_odd_rows(spark, write_tables):
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=6)], None if k % 4 == 0 else 7) for k in range(40)]
    rows += [(40, None, 7), (41, [1.0, None, 2.0, 0.0, 0.0, 0.0], 7), (42, [float("nan")] * 6, 7), (43, [float("inf")] * 6, None), (44, [], 1), (45, [0.5], 1), (46, [0.25] * 7, 1)]
    rows += [(3, rows[3][1], None), (3, rows[3][1], None), (None, [0.1] * 6, 2), (50, [1e9, -1e9, 0.0, 0.0, 1e7, 5.0, 1.0], 2)] + [(100 + k, [0.125] * 6, 3) for k in range(30)]
    assert result(rows, spark, write_tables) == brute(rows)


def test_blocks_are_joined_and_hot_labels_are_split(spark, write_tables, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, [float(v) for v in rng.integers(-3, 3, 4)], 0 if k % 3 else k) for k in range(900)]
    monkeypatch.setattr(veccodes, "HOT_PART", 4)
    assert result(rows, spark, write_tables, 7) == brute(rows)


def test_distances_beyond_doubles_are_exact():
    x, c = np.array([[2.0**40, 3.0], [1.0, -(2.0**40)]]), np.array([[2.0**40, 3.0], [0.0, 1.0]])
    want = [[0, 2**80 + 4], [(2**40 - 1) ** 2 + (2**40 + 3) ** 2, 1 + (2**40 + 1) ** 2]]
    assert veccodes.squared(x, c).tolist() == want


def test_no_rows(spark, write_tables):
    assert result([], spark, write_tables) == []
    assert result([(1, None, 1)], spark, write_tables) == []


@pytest.mark.parametrize("names", [("code", "error"), ("vectors", "changed")])
def test_clashing_names(spark, names):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 5), (2, [1.0, 2.0, 3.0, 5.0], 5)], f"{names[0]} long, group array<double>, {names[1]} int").withColumn("key", F.lit(1))
    out, _ = veccodes.codes(df, names[0], "group", names[1])
    assert sorted(r[2] for r in out.collect()) == ["00000000", "00000001"]


def test_query_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_small}/embeddings.parquet'")
    want = con.sql(veccodes.OP13_SQL)
    got = veccodes.op13_vector_codes(spark, sf_small).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
