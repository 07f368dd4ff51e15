"""Exact top-k search by inner product with a pivot table.

Every vector has its distances to a few pivots. By the triangle inequality
their differences bound the distance of a query and a candidate from below,
and so the inner product from above. Candidates are evaluated in the order of
that bound until no bound that is left reaches the k-th best score, which
starts at the one found in a bounded sample and rises as they are evaluated.
Candidates lie in blocks of bounded size, those of one nearest pivot together,
and a few blocks make a group. Intervals of pivot distances tell for a block
of queries which groups may hold anything for it; it goes to those alone, and
each group reads its candidates once and lets the queries pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.llm._common import stored, table

K = 20
SCALE = 64.0
#: Rows in a block of candidates, and of queries.
CANDIDATES, QUERIES = 4096, 512
#: Pivots, and the rows they are chosen from and first thresholds are found in.
PIVOTS, SAMPLE = 16, 2048
#: Blocks of candidates in a group, about.
GROUP = 8

_BLOCK = "task int, part int, n int, dim int, ids binary, vectors binary, norms binary, pivots binary, low binary, high binary, norm double"


def scaled(column: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(64 x) of the vectors that take part, shorter ones filled up with zeros.

    Left out: null ids, null vectors, null or non-finite components.
    """
    if isinstance(column, pa.ChunkedArray):
        column, ids = column.combine_chunks(), ids.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(invalid="ignore"):
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(SCALE * flat)
    good &= np.isfinite(out).all(axis=1)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[good], out[good]


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def choose_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows each as far as can be from those before."""
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    chosen = [0]
    far = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    dim = max(x.shape[1], pivots.shape[1])
    x, pivots = _wide(x, dim), _wide(pivots, dim)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def products(x: np.ndarray, q: np.ndarray, peak: float | None = None) -> np.ndarray:
    """Exact integer inner products; those outside 64 bits become the nearest end of that range.

    `peak`: a number that no component of `x` is over, if one is known.
    """
    most = (np.abs(x).max(initial=0) if peak is None else peak) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    if most < 2.0**53:
        return (x @ q).astype(np.int64)
    exact = [int(v) for v in q]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(int(a) * b for a, b in zip(row, exact)))) for row in x], dtype=np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))[:k]
    return ids[order], scores[order]


def margins(far: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivot distances [row, pivot] less and plus what rounding may have done to them, as [pivot, row]."""
    rounded = (dim + 8) * np.finfo(np.float64).eps + np.finfo(far.dtype).eps
    far = np.ascontiguousarray(far.T, dtype=np.float64)
    return far * (1 - rounded), far * (1 + rounded)


def bounds(norm: float, q_less: np.ndarray, q_more: np.ndarray, norms: np.ndarray, less: np.ndarray, more: np.ndarray, dim: int) -> np.ndarray:
    """What the inner product of a query with each candidate can't be over, whatever was rounded.

    Every gap is lowered by the error of its own two distances, so a pivot far
    from both says nothing instead of too much. A bound that is not finite is
    infinite. None is below the least score, which clamped products share.
    """
    slack = (dim + 8) * np.finfo(np.float64).eps
    with np.errstate(over="ignore", invalid="ignore"):
        total = norms + norm
        gap = np.maximum(less - q_more[:, None], q_less[:, None] - more).max(axis=0, initial=0.0)
        bound = 0.5 * (total - gap * gap) + 0.5 + slack * total
    bound[~np.isfinite(bound)] = np.inf
    return np.maximum(bound, -(2.0**63))


def search(query: np.ndarray, own: int, floor: float, q_far: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, far: tuple[np.ndarray, np.ndarray], k: int, step: int = 1024, peak: float | None = None):
    """The k best of some rows by score, then id, among candidates that can reach `floor`; and how many were evaluated.

    `far`: what `margins` makes of their pivot distances.
    """
    q_less, q_more = margins(q_far[None, :], x.shape[1])
    bound = bounds(float(query @ query), q_less[:, 0], q_more[:, 0], norms, *far, x.shape[1])
    able = np.flatnonzero((bound >= floor) & (ids != own))
    able = able[np.argsort(-bound[able], kind="stable")]
    top_ids, top = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(able):
        if len(top) == k and bound[able[at]] < top[-1]:
            break
        part = able[at : at + step]
        found = products(x[part], query, peak)
        keep = found >= (max(floor, float(top[-1])) if len(top) == k else floor)
        if keep.any():
            top_ids, top = best(np.concatenate([top_ids, ids[part][keep]]), np.concatenate([top, found[keep]]), k)
        at += len(part)
        step *= 2
    return top_ids, top, at


def block_bound(norm: float, low: np.ndarray, high: np.ndarray, q_norm: float, q_low: np.ndarray, q_high: np.ndarray, dim: int) -> float:
    """What no inner product of a candidate and a query of two blocks can be over, from their intervals of pivot distances."""
    slack = (dim + 8) * np.finfo(np.float64).eps
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(low - q_high, q_low - high) - 2 * slack * (high + q_high)
        gap = float(gap.max(initial=0.0))
        bound = 0.5 * (norm + q_norm - gap * gap) + 0.5 + slack * (norm + q_norm)
    return max(bound, -(2.0**63)) if np.isfinite(bound) else np.inf


def blocks(df: DataFrame, key: str, vector: str, pivots: np.ndarray, rows: int) -> DataFrame:
    """One row for each block of up to `rows` vectors with one nearest pivot.

    Holds ids, scaled vectors, squared norms and pivot distances, and of these
    the least, the greatest, and the greatest norm.
    """
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def pack(batches):
        task, part = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def row(at: int):
            own = waiting.pop(at)
            del sizes[at]
            dim = max(v.shape[1] for _, v in own)
            x = np.concatenate([_wide(v, dim) for _, v in own])
            far, norms = distances(x, shared.value), (x * x).sum(axis=1)
            found = {"task": task, "part": part, "n": len(x), "dim": dim, "ids": np.concatenate([i for i, _ in own]).tobytes(), "vectors": x.tobytes(), "norms": norms.tobytes(), "pivots": far.tobytes()}
            found |= {"low": far.min(axis=0).tobytes(), "high": far.max(axis=0).tobytes(), "norm": float(norms.max())}
            kinds = [("task", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "norms", "pivots", "low", "high")), ("norm", pa.float64())]
            return pa.RecordBatch.from_pylist([found], schema=pa.schema(kinds))

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                ids, x = scaled(piece.column(1), piece.column(0))
                far = distances(x, shared.value)
                nearest = far.argmin(axis=1) if far.shape[1] else np.zeros(len(x), dtype=np.int64)
                for p in np.unique(nearest).tolist():
                    mine = nearest == p
                    if p in sizes and sizes[p] + int(mine.sum()) > rows:
                        yield row(p)
                        part += 1
                    waiting.setdefault(p, []).append((ids[mine], x[mine]))
                    sizes[p] = sizes.get(p, 0) + int(mine.sum())
        for p in sorted(waiting):
            yield row(p)
            part += 1

    return df.select(F.col(key).cast("long"), vector).mapInArrow(pack, _BLOCK)


def top_k(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """The `k` candidates of highest inner product for each query row: query_id, rank, vec_id, score.

    Components are scaled by 64 and rounded down. Every row is a candidate
    for all queries but that of its own id. Ties go to the smaller id; fewer
    candidates than k give all. Null ids or vectors and null or non-finite
    components take no part; a shorter vector counts as filled up with zeros.
    Several query rows of one id are one query, by the least vector; several
    candidate rows of one id are several candidates. An empty table gives no row.
    """
    spark = df.sparkSession
    rows = df.select(key, vector)
    taken = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).toArrow()
    sample_ids, sample = scaled(taken.column(1), taken.column(0))
    pivots = choose_pivots(sample)
    queries = rows.where(is_query).groupBy(key).agg(F.min(vector).alias(vector))
    held = stored(blocks(rows, key, vector, pivots, CANDIDATES), "candidates")
    seeds = spark.sparkContext.broadcast((sample_ids, sample))
    groups = max(1, held.count() // GROUP)
    width = len(pivots)

    def unpack(r):
        n, dim = r["n"], r["dim"]
        return np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["vectors"]).reshape(n, dim), np.frombuffer(r["norms"]), np.frombuffer(r["pivots"]).reshape(n, width)

    def first_floor(batches):
        """Adds to each block of queries the k-th best score in the sample, which the final one can't be under."""
        for batch in batches:
            floors = []
            for r in batch.to_pylist():
                ids, q, _, _ = unpack(r)
                seed_ids, seed = seeds.value
                dim = max(q.shape[1], seed.shape[1])
                q, seed = _wide(q, dim), _wide(seed, dim)
                low = np.full(len(q), -np.inf)
                for j in range(len(q)):
                    found = products(seed[seed_ids != ids[j]], q[j])
                    if len(found) >= k:
                        low[j] = np.partition(found, len(found) - k)[len(found) - k]
                floors.append(low)
            least = pa.array([low.min() for low in floors], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([low.tobytes() for low in floors], pa.binary()), least], names=[*batch.schema.names, "floors", "floor"])

    asked = stored(blocks(queries, key, vector, pivots, QUERIES).mapInArrow(first_floor, _BLOCK + ", floors binary, floor double"), "queries")

    # a stated query set against all rows, block by block: first which blocks may meet, from a few numbers of each
    dealt = held.withColumn("group", F.pmod(F.xxhash64("task", "part"), F.lit(groups)).cast("int"))
    numbers = ["dim", "norm", "low", "high"]
    wide_q = asked.select("task", "part", "floor", *[F.col(c).alias(f"q_{c}") for c in numbers], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = dealt.select("group", *numbers).join(wide_q, "group")

    def may_hold(batches):
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                low, high, q_low, q_high = (np.frombuffer(r[c]) for c in ("low", "high", "q_low", "q_high"))
                keep.append(block_bound(r["norm"], low, high, r["q_norm"], q_low, q_high, max(r["dim"], r["q_dim"])) >= r["floor"])
            yield batch.select(["task", "part", "group"]).filter(pa.array(keep, pa.bool_()))

    goes = met.mapInArrow(may_hold, "task int, part int, group int").distinct()
    sent = asked.join(goes, ["task", "part"]).withColumn("asks", F.lit(1))
    both = dealt.withColumn("floors", F.lit(None).cast("binary")).withColumn("floor", F.lit(None).cast("double")).withColumn("asks", F.lit(0)).unionByName(sent)
    both = both.repartition(groups, "group").sortWithinPartitions("group", "asks", "task", "part")

    def match(batches):
        here, kept, whole = None, [], None
        for r in (r for batch in batches for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
            if r["group"] != here:
                here, kept, whole = r["group"], [], None
            if not r["asks"]:
                kept.append(unpack(r))
                continue
            if not kept:
                continue
            if whole is None:  # all candidates of the group are there; queries follow
                dim = max(x.shape[1] for _, x, _, _ in kept)
                far = np.concatenate([f for _, _, _, f in kept])
                whole = np.concatenate([i for i, _, _, _ in kept]), np.concatenate([_wide(x, dim) for _, x, _, _ in kept]), np.concatenate([n for _, _, n, _ in kept]), margins(far, max(dim, width)), max(float(np.abs(x).max()) for _, x, _, _ in kept)
            ids, x, norms, far, peak = whole
            q_ids, q, _, q_far = unpack(r)
            floors = np.frombuffer(r["floors"])
            if q.shape[1] > x.shape[1]:
                x = _wide(x, q.shape[1])
            q = _wide(q, x.shape[1])
            out = [search(q[j], q_ids[j], floors[j], q_far[j], ids, x, norms, far, k, peak=peak) for j in range(len(q))]
            columns = [np.repeat(q_ids, [len(t[0]) for t in out]), np.concatenate([t[0] for t in out]), np.concatenate([t[1] for t in out])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(match, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of each query row of `embeddings`; null, non-finite and repeated rows as `top_k` says."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
