"""Vector code compression: a codebook for each part of the vectors, by Lloyd's rounds with heaps.

Vectors become integers and are cut into equal parts; a part is coded as the
nearest entry of its position's codebook. In a block of vectors each entry has
a heap of the parts assigned to it. A part's key is how much closer its entry
is than any other, lower bound less upper bound, plus what the entry's limit
was when the part was scanned; the limit rises by how far the entry and the
farthest-moving other one have drifted since. So in each round only the heads
of the heaps, up to the limit, are popped and compared with all entries again;
for all others the triangle inequality says that nothing has changed. Heaps
are arrays in ascending order, which are heaps, a row of a stored table for
each block; entries' sums change by what moved and are added up in the cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm._common import claim, discard, fresh, stored, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Vectors in a block.
BLOCK = 8192
#: Scaled components are kept within this; beyond it a double has no fraction to round.
LIMIT = 2.0**52
#: A group with more than this part of all rows is hot, of which there can be no more than so many.
HOT_PART = 256

_SUM = pa.decimal128(38, 0)
_CHANGED = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(_SUM))]))


def integers(vectors: pa.Array, dim: int, scale: float = SCALE) -> np.ndarray:
    """floor(scale x) of each component, as doubles, in rows of `dim` that are filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    with np.errstate(over="ignore"):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(scale * flat), -LIMIT, LIMIT)
    return out


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances [row, entry]: doubles as long as they hold them, Python's integers beyond."""
    peak = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * x.shape[1] * peak * peak < 2.0**53:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    exact, found = x.astype(np.int64).astype(object), entries.astype(np.int64).astype(object)
    return np.stack([((exact - e) ** 2).sum(axis=1) for e in found], axis=1) if len(found) else np.zeros((len(x), 0), dtype=object)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index, and how much closer it is than any other, never too much."""
    d = squared(x, entries)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    near = d[rows, best].astype(np.float64)
    d[rows, best] = np.inf
    other = d.min(axis=1).astype(np.float64) if d.shape[1] > 1 else np.full(len(x), np.inf)
    near, other = np.sqrt(near), np.sqrt(other)
    with np.errstate(invalid="ignore"):
        return best, np.where(np.isinf(other), np.inf, other - near - (near + other) * 1e-12)


class Heaps:
    """The heaps of one part position of a block: rows by entry and key, ascending."""

    def __init__(self, count: int, entries: int, order: np.ndarray | None = None, keys: np.ndarray | None = None, codes: np.ndarray | None = None):
        """Without an order nothing is assigned yet, and all is popped first."""
        self.entries = entries
        self.order = np.arange(count, dtype=np.int32) if order is None else order
        self.keys = np.full(count, -np.inf) if keys is None else keys
        self.codes = np.zeros(count, dtype=np.uint8) if codes is None else codes
        self.starts = np.searchsorted(self.codes[self.order], np.arange(entries + 1))

    def pop(self, limits: np.ndarray) -> np.ndarray:
        """Places in the order of what each entry's limit has reached: the head of its heap, found by bisection of all heaps at once."""
        low, high = self.starts[:-1].copy(), self.starts[1:].copy()
        while (low < high).any():
            middle = (low + high) // 2
            reached = (low < high) & (self.keys[np.minimum(middle, len(self.keys) - 1)] <= limits)
            low = np.where(reached, middle + 1, low)
            high = np.where(reached, high, middle)
        n = low - self.starts[:-1]
        return np.arange(n.sum()) + np.repeat(self.starts[:-1] - (np.cumsum(n) - n), n)

    def turn(self, x: np.ndarray, entries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scan what is popped and push it again: rows scanned, their codes before and after."""
        head = self.pop(limits)
        rows = self.order[head]
        before = self.codes[rows]
        best, slack = nearest(x[rows], entries)
        self.codes[rows] = best
        kept = np.ones(len(self.order), dtype=bool)
        kept[head] = False
        order = np.concatenate([self.order[kept], rows])
        keys = np.concatenate([self.keys[kept], slack + limits[best]])
        at = np.lexsort((keys, self.codes[order]))
        self.order, self.keys = order[at], keys[at]
        self.starts = np.searchsorted(self.codes[self.order], np.arange(self.entries + 1))
        return rows, before, self.codes[rows]


def moved(x: np.ndarray, before: np.ndarray, after: np.ndarray, entries: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """By how much what was scanned changes each entry's count and sums."""
    n = np.zeros(entries, dtype=np.int64)
    wide = np.abs(x).max(initial=0) * max(1, len(x)) >= 2.0**62
    sums = np.zeros((entries, x.shape[1]), dtype=object if wide else np.int64)
    change = np.ones(len(x), dtype=bool) if first else before != after
    x = x[change].astype(np.int64).astype(sums.dtype)
    np.add.at(n, after[change], 1)
    np.add.at(sums, after[change], x)
    if not first:
        np.subtract.at(n, before[change], 1)
        np.subtract.at(sums, before[change], x)
    return n, sums


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    wide = x.shape[1] // parts
    return [np.ascontiguousarray(x[:, p * wide : (p + 1) * wide]) for p in range(parts)]


class Codebooks:
    """All positions' entries, with each entry's limit so far, its count and sums."""

    def __init__(self, first: np.ndarray, parts: int):
        self.parts = parts
        self.entries = _cut(first, parts)
        self.limits = np.zeros((parts, len(first)))
        self.n = np.zeros((parts, len(first)), dtype=object)
        self.sums = [np.zeros(e.shape, dtype=object) for e in self.entries]

    def add(self, rows) -> None:
        for part, entry, at, change in rows:
            if at < 0:
                self.n[part, entry] += int(change)
            else:
                self.sums[part][entry, at] += int(change)

    def update(self) -> None:
        """Each entry becomes the floor of its mean; limits rise by its drift and the greatest one of the others."""
        for p, old in enumerate(self.entries):
            new = old.copy()
            for e in range(len(old)):
                if self.n[p, e]:
                    new[e] = [float(s // self.n[p, e]) for s in self.sums[p][e]]
            drift = np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + 1e-12)
            if len(drift) > 1:
                first, second = np.argsort(-drift)[:2]
                others = np.where(np.arange(len(drift)) == first, drift[second], drift[first])
                self.limits[p] = (self.limits[p] + drift + others) * (1 + 1e-12)
            self.entries[p] = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for row in e for v in row).encode()).hexdigest()


def _changed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    out = []
    for p, (n, sums) in enumerate(parts):
        for e in np.flatnonzero((n != 0) | (sums != 0).any(axis=1)).tolist():
            out.append({"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()})
    return out


def _sums(blocks: DataFrame) -> list:
    """Changes of counts (position -1) and sums over all blocks, by part, entry and position: as many rows as the codebooks have numbers."""
    c = blocks.select(F.explode("changed").alias("c")).select("c.part", "c.entry", F.concat(F.array(F.col("c.n").cast("decimal(38,0)")), "c.sums").alias("all"))
    each = c.select("part", "entry", F.posexplode("all").alias("at", "change"))
    found = each.groupBy("part", "entry", "at").agg(F.sum("change").alias("change"))
    return [(r[0], r[1], r[2] - 1, r[3]) for r in found.collect()]


def codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, str]:
    """Code and error of each vector that takes part, with key and group; and the digest of the codebooks.

    Left out: null vectors, and those with a null or non-finite component.
    Each component becomes floor(scale x), within 2^52. Shorter vectors count
    as filled up with zeros, to a multiple of `parts`. The codebooks begin with
    the vectors of the least keys, fewer where there are fewer; of several rows
    of one key the least vector counts there, and a null key comes last. Rows
    that repeat are coded each. Errors beyond 64 bits become the greatest
    number of 64 bits. An empty table gives no row and the digest of nothing.
    """
    spark, before = df.sparkSession, written()
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(group).alias("group")).where(F.col("vector").isNotNull() & finite)
    dim = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    dim = -(-dim // parts) * parts
    least = F.broadcast(kept.select(F.col("key").alias("least")).distinct().orderBy(F.col("least").asc_nulls_last()).limit(entries))  # so many rows
    first = kept.join(least, F.col("key").eqNullSafe(F.col("least"))).groupBy("key").agg(F.min("vector").alias("vector")).orderBy(F.col("key").asc_nulls_last()).select("vector").toArrow()
    books = Codebooks(integers(first.column(0).combine_chunks(), dim, scale), parts)
    size = first.num_rows

    fields = [T.StructField("keys", T.ArrayType(kept.schema["key"].dataType)), T.StructField("groups", T.ArrayType(kept.schema["group"].dataType)), T.StructField("vectors", T.BinaryType())]
    fields += [T.StructField(c, T.BinaryType()) for c in ("codes", "order", "limits")]
    schema = T.StructType([*fields, T.StructField("changed", T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])))])

    def deal(batches):
        """Blocks of vectors, of which nothing is assigned yet."""
        claim("veccodes")
        waiting: list[pa.RecordBatch] = []

        def block():
            rows = pa.Table.from_batches(waiting).combine_chunks()
            x = integers(rows.column("vector").combine_chunks(), dim, scale)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows.column(c).combine_chunks()) for c in ("key", "group")]
            return lists, x, [Heaps(len(x), size) for _ in range(parts)]

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if waiting and sum(b.num_rows for b in waiting) + piece.num_rows > BLOCK:
                    yield block()
                    waiting.clear()
                waiting.append(piece)
        if waiting:
            yield block()

    def reread(batches):
        claim("veccodes")
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                get = lambda c, kind: np.frombuffer(row.column(c)[0].as_py(), dtype=kind)
                n = len(row.column("keys")[0])
                x = get("vectors", "<i4" if len(row.column("vectors")[0].as_py()) == 4 * n * dim else "<i8").reshape(n, dim).astype(np.float64)
                order, keys, code = get("order", "<i4").reshape(parts, n), get("limits", "<f8").reshape(parts, n), get("codes", "u1").reshape(parts, n)
                yield [row.column("keys"), row.column("groups")], x, [Heaps(n, size, order[p].copy(), keys[p].copy(), code[p].copy()) for p in range(parts)]

    def turn(blocks, books, start):
        for lists, x, heaps in blocks:
            narrow = np.abs(x).max(initial=0) < 2**31
            changes = []
            for heap, own, entries_, limits in zip(heaps, _cut(x, parts), books.entries, books.limits):
                rows, was, now = heap.turn(own, entries_, limits)
                changes.append(moved(own[rows], was, now, size, start))
            raw = [x.astype("<i4" if narrow else "<i8").tobytes(), np.concatenate([h.codes for h in heaps]).tobytes(), np.concatenate([h.order for h in heaps]).tobytes(), np.concatenate([h.keys for h in heaps]).tobytes()]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([r], pa.binary()) for r in raw), pa.array([_changed(changes)], _CHANGED)], names=schema.names)

    def finish(blocks, books):
        for lists, x, heaps in blocks:
            error = np.zeros(len(x), dtype=object)
            for heap, own, entries_, limits in zip(heaps, _cut(x, parts), books.entries, books.limits):
                heap.turn(own, entries_, limits)
                gap = own.astype(np.int64) - entries_[heap.codes].astype(np.int64)
                small = np.abs(gap).max(initial=0) ** 2 * max(1, gap.shape[1]) < 2**62
                error += (gap * gap).sum(axis=1) if small else (gap.astype(object) ** 2).sum(axis=1)
            names = np.stack([np.array([f"{k:02x}" for k in range(256)], dtype=object)[h.codes] for h in heaps], axis=1)
            code = ["".join(row) for row in names]
            flat = [c.flatten() if isinstance(c, pa.Array) else c.combine_chunks().flatten() for c in lists]
            yield pa.RecordBatch.from_arrays([*flat, pa.array(code, pa.string()), pa.array([min(int(e), 2**63 - 1) for e in error], pa.int64())], names=["key", "group", "code", "error"])

    blocks = None
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        if blocks is None:
            now = kept.mapInArrow(lambda batches, b=shared: turn(deal(batches), b.value, True), schema)
        else:
            now = blocks.mapInArrow(lambda batches, b=shared: turn(reread(batches), b.value, False), schema)
        blocks, old = stored(now, f"round{k}"), blocks
        books.add(_sums(blocks))
        books.update()
        if old is not None:
            discard(spark, before, blocks)
    last = spark.sparkContext.broadcast(books)
    kind = T.StructType([kept.schema["key"], kept.schema["group"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = stored(blocks.mapInArrow(lambda batches, b=last: finish(reread(batches), b.value), kind), "codes")
    discard(spark, before, coded)
    return coded.toDF(key, group, *fresh(df.select(key, group), "code", "error")), books.digest()


def with_group_sums(df: DataFrame, group: str, value: str, total: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of equal `group`, nulls together. `df` should be stored.

    Groups with more than a HOT_PART-th of all rows, fewer than HOT_PART of
    them, are broadcast, so that none is gathered into one task; the others
    are joined by a shuffle. Sums beyond 64 bits become the greatest number of
    64 bits. An empty table stays empty.
    """
    n_, group_ = fresh(df, "_n", "_group")
    whole = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = df.groupBy(F.col(group).alias(group_)).agg(whole.alias(total), F.count("*").alias(n_))
    bar = df.count() // HOT_PART
    same = F.col(group).eqNullSafe(F.col(group_))
    hot = F.broadcast(sums.where(F.col(n_) > bar).drop(n_))
    cold = sums.where(F.col(n_) <= bar).drop(n_)
    rest = df.join(F.broadcast(sums.where(F.col(n_) > bar).select(group_)), same, "left_anti")
    return df.join(hot, same).drop(group_).unionByName(rest.join(cold, same).drop(group_))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings` after four rounds, with errors by vector and by label; odd rows as `codes` says."""
    coded, digest = codes(table(spark, sf_dir, "embeddings"))
    out = with_group_sums(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, with one common table for each step of each round."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
    steps = [
        f"""v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE:.0f} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // {PARTS} + 1 : (part + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) AS t(part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(CAST({distance} AS HUGEINT) * {ENTRIES} + entry) AS m FROM p JOIN c{k} USING (part) GROUP BY vec_id, part)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT part, m % {ENTRIES} AS entry, pos, sum(x[pos]) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) GROUP BY ALL)")
            steps.append(f"n{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM s{k} GROUP BY part, entry)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN n{k} n ON o.part = n.part AND o.entry = n.entry)")
    last = f"""
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN (SELECT vec_id, string_agg(printf('%02x', CAST(m % {ENTRIES} AS BIGINT)), '' ORDER BY part) AS code, sum(m // {ENTRIES}) AS error FROM a{ROUNDS} GROUP BY vec_id) USING (vec_id)"""
    return "WITH " + ",\n".join(steps) + last


OP13_SQL = _sql()
