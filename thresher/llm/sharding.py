"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together. A group goes to the shard where the dot
product of its sizes with what the shard has left is highest. Large groups,
of which there can only be so many, are placed one by one; small ones by
buckets of a fixed number, so the driver works on a bounded list whatever the
corpus. Only a group that no shard can hold is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm._common import discard, fresh, stored, table, text_or_empty, written

SHARDS = 16
#: Buckets that small groups are dealt to.
BUCKETS = 1 << 14
#: A group is placed by itself from this part of a shard on, in any of its sizes.
LARGE = 1 / 64


def assign(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit by vector bin packing; `sizes` [unit, dimension].

    Sizes count as parts of an equal share. Units go in decreasing order of
    their largest part, each to the shard with the highest dot product among
    those that have room, or else to the one with most of the first dimension
    left.
    """
    total = sizes.sum(axis=0).astype(float)
    parts = sizes / np.where(total > 0, total / shards, 1.0)
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), dtype=np.int64)
    for u in np.argsort(-parts.max(axis=1), kind="stable"):
        room = (left >= parts[u] - 1e-12).all(axis=1)
        worth = np.where(room, left @ parts[u], -np.inf) if room.any() else left[:, 0]
        s = int(worth.argmax())
        out[u] = s
        left[s] -= parts[u]
    return out


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit, as `assign` gives it, with the first dimension near equal.

    Units move from the fullest shard to the emptiest while that narrows it.
    """
    out = assign(sizes, shards)
    first = sizes[:, 0].astype(np.int64)
    load = np.bincount(out, weights=first, minlength=shards).astype(np.int64)
    for _ in range(64 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        mine = np.flatnonzero(out == high)
        mine = mine[(first[mine] > 0) & (first[mine] < gap)]
        if gap <= 1 or not len(mine):
            break
        u = mine[np.abs(first[mine] - gap / 2).argmin()]
        out[u] = low
        load[high] -= first[u]
        load[low] += first[u]
    return out


def shard(df: DataFrame, group: str, sizes: list[str], shards: int = SHARDS) -> DataFrame:
    """`df` with shard and slot: rows of one `group` (a 64-bit hash) share a shard.

    `sizes` are long columns without nulls, the first the one to be near
    equal. A group above a whole share of any size is dealt out to as many
    shards as it needs, row by row in turn. Slots count from 0 in each shard
    without gaps. Columns named shard or slot are replaced, all others stay.
    An empty table stays empty. `df` should be slim: it is written once before
    and once after shards are known.
    """
    spark = df.sparkSession
    df = df.select(*[c for c in df.columns if c not in ("shard", "slot")])
    before = written()
    rows = stored(df, "sized")
    task_, nth_, before_, shard_, of_ = fresh(df, "_task", "_nth", "_before", "_shard", "_of")
    totals = [max(1, t or 0) for t in rows.agg(*[F.sum(c) for c in sizes]).first()]
    groups = rows.groupBy(F.col(group).alias("group")).agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(sizes)])
    bar = [t / shards * LARGE for t in totals]
    large = F.greatest(*[F.col(f"s{k}") >= F.lit(b) for k, b in enumerate(bar)]) if len(sizes) > 1 else F.col("s0") >= F.lit(bar[0])
    keyed = groups.select(large.alias("large"), F.when(large, F.col("group")).otherwise(F.pmod(F.col("group"), F.lit(BUCKETS))).alias("unit"), *[f"s{k}" for k in range(len(sizes))])
    # at most shards / LARGE large groups for each size, and BUCKETS buckets
    units = keyed.groupBy("large", "unit").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(sizes))]).orderBy("large", "unit").collect()
    listed: list[tuple[bool, int]] = []
    amounts: list[list[float]] = []
    for r in units:
        own = [r[f"s{k}"] for k in range(len(sizes))]
        most = max(a / (t / shards) for a, t in zip(own, totals))
        chunks = 1 if most <= 1 or not r["large"] else int(np.ceil(4 * most))
        listed += [(r["large"], r["unit"])] * chunks
        amounts += [[a / chunks for a in own]] * chunks
    where = place(np.array(amounts, dtype=float).reshape(-1, len(sizes)), shards)
    bucket_of = np.zeros(BUCKETS, dtype=np.int32)
    split: dict[int, list[int]] = {}
    for (is_large, unit), s in zip(listed, where):
        if is_large:
            split.setdefault(unit, []).append(int(s))
        else:
            bucket_of[unit] = s
    shared = spark.sparkContext.broadcast((bucket_of, split))
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(task_, T.IntegerType()), T.StructField(nth_, T.LongType())])

    def deal(batches):
        task = TaskContext.get().partitionId()
        buckets, split = shared.value
        keys = np.array(sorted(split), dtype=np.int64)
        seen = np.zeros(shards, dtype=np.int64)
        turn = dict.fromkeys(split, task)
        for batch in batches:
            g = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False).astype(np.int64)
            to = buckets[g % BUCKETS].astype(np.int64)
            for i in np.flatnonzero(np.isin(g, keys)):
                own = split[int(g[i])]
                to[i] = own[turn[int(g[i])] % len(own)]
                turn[int(g[i])] += 1
            nth = np.zeros(len(g), dtype=np.int64)
            for s in np.unique(to):
                at = np.flatnonzero(to == s)
                nth[at] = seen[s] + np.arange(len(at))
                seen[s] += len(at)
            added = [pa.array(to.astype(np.int32)), pa.array(np.full(len(g), task, dtype=np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "shard", task_, nth_])

    placed = stored(rows.mapInArrow(deal, schema), "sharded")
    discard(spark, before, placed)
    per_task = placed.groupBy(F.col("shard").alias(shard_), F.col(task_).alias(of_)).agg(F.count("*").alias("n"))
    order = Window.partitionBy(shard_).orderBy(of_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = per_task.select(shard_, of_, (F.sum("n").over(order) - F.col("n")).alias(before_))
    joined = placed.join(earlier, (F.col("shard") == F.col(shard_)) & (F.col(task_) == F.col(of_)))
    return joined.select(*df.columns, "shard", (F.col(before_) + F.col(nth_)).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by law `bytes`; null text has size 1 and shares a group with empty text, rows that repeat an id each have a slot."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.xxhash64(text).alias("group"),
    )
    return shard(docs, "group", ["size", "tokens", "rows"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
