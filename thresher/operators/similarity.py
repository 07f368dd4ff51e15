"""Extensions: looking up equal and near fragments.

The embedding is a vector of hashed character n-grams of the normal form, of
length one; it is deterministic and has no model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.scratch import place, stored

DIMENSION = 64
GRAM = 3
BASE = 1009


def exact_duplicates(df: DataFrame, form: str, key: str) -> DataFrame:
    """Groups of rows with one normal form: digest, n, first_key. Aggregation starts before the shuffle."""
    digest = F.sha2(F.col(form), 256).alias("digest")
    return df.select(digest, key).groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def embed(text: Column, dimension: int = DIMENSION, gram: int = GRAM) -> Column:
    """Counts of hashed n-grams, divided by their Euclidean length; zeros for null text and text shorter than one n-gram.

    An n-gram's hash is its code points as digits to the base BASE, modulo the dimension.
    """

    def run(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), dimension))
        for row, t in zip(rows, texts.to_pylist()):
            codes = np.frombuffer((t or "").encode("utf-32-le"), dtype="<u4").astype(np.int64)
            if len(codes) >= gram:
                n = len(codes) - gram + 1
                bins = sum(codes[k : k + n] * BASE ** (gram - 1 - k) for k in range(gram)) % dimension
                row += np.bincount(bins, minlength=dimension)
        rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return F.arrow_udf(run, "array<double>")(text)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector divided by its length, in double precision. Null for a vector without a direction: null, all zeros, or with a null or non-finite component."""
    length = F.sqrt(dot(vector, vector))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    fits = whole & (length > 0) & (length < F.lit(float("inf")))
    return F.when(fits, F.transform(vector, lambda x: F.try_divide(x.cast("double"), length)))


PACK = "ids array<long>, dim int, units binary"


def packed(rows: DataFrame, size: int, group: str | None = None) -> DataFrame:
    """Up to `size` rows (id, unit) in one row each; of one `group` only, an integer by which they lie sorted, if that is given."""

    def pack(batches):
        for batch in batches:
            own = batch.column(2).to_numpy() if group else np.zeros(batch.num_rows)
            starts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1)).tolist() if len(own) else []
            for first, end in zip(starts, [*starts[1:], batch.num_rows]):
                for at in range(first, end, size):
                    part = batch.slice(at, min(size, end - at))
                    vectors = part.column(1).to_pylist()
                    dim = max(map(len, vectors))
                    x = np.zeros((len(vectors), dim))
                    for row, v in zip(x, vectors):
                        row[: len(v)] = v
                    columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([x.tobytes()], pa.binary())]
                    names = ["ids", "dim", "units"]
                    if group:
                        columns, names = [*columns, pa.array([int(own[at])], pa.int32())], [*names, group]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(pack, PACK + (f", {group} int" if group else ""))


def best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Of each pair of a block and a block of queries (`q_`), the k best of each query: query_id, neighbor_id, similarity."""

    def match(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.array(r["ids"], dtype=np.int64), np.array(r["q_ids"], dtype=np.int64)
                x, q = np.frombuffer(r["units"]).reshape(len(ids), r["dim"]), np.frombuffer(r["q_units"]).reshape(len(q_ids), r["q_dim"])
                dim = min(r["dim"], r["q_dim"])  # what is filled up adds nothing
                similar = np.round(q[:, :dim] @ x[:, :dim].T, 6) + 0.0
                similar[q_ids[:, None] == ids[None, :]] = -np.inf
                rows, found = [], []
                for i, row in enumerate(similar):
                    at = np.flatnonzero(row >= (np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2.0))
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    rows.append(np.full(len(at), i))
                    found.append(at)
                i, j = np.concatenate(rows), np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(similar[i, j])], names=["query_id", "neighbor_id", "similarity"])

    return pairs.mapInArrow(match, "query_id long, neighbor_id long, similarity double").where("similarity >= -2")


def cosine_top_k(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """For each query the k candidates of highest cosine similarity, rounded to six digits; ties by key.

    `queries` is a stated set against all candidates. Lengths are taken once a
    vector; blocks of candidates meet blocks of queries, and each pair of
    blocks gives at most k rows for a query. Keys are 64-bit integers; null
    keys and vectors without a direction take no part, a shorter vector
    counts as filled up with zeros, and a row is no neighbour of its own key.
    """
    units = lambda df: df.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("unit")).where("id is not null and unit is not null")
    groups = max(1, candidates.count() // block)
    asked = packed(units(queries), block // 4).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "dim", "units")], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    held = packed(units(candidates).repartition(groups), block).withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    found = best_pairs(held.join(asked, "_group").drop("_group"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_duplicates(df: DataFrame, form: str, key: str, least: float, k: int = 10) -> DataFrame:
    """Up to k nearest rows of each, by the cosine of the embeddings of their normal form, from `least` on.

    By a stored index, exactly: each row is compared in the cells that may
    hold anything as near. Null keys and forms too short for an n-gram have no
    neighbours; an empty table gives no row.
    """
    from thresher.operators.vectorindex import VectorIndex

    rows = stored(df.select(F.col(key).alias("id"), embed(F.col(form)).alias("unit")), "embedded")
    return VectorIndex.build(rows, "id", "unit", place(df.sparkSession, "vectors")).lookup(rows, "id", "unit", k, least=least)
