"""A fitted embedding of fragments: hashed n-grams, weighted by how few fragments hold them.

All of it are column expressions and joins with a table of fixed size, one row
for each bin that a fragment fell into when the model was fitted; bins that are
to be stored may come from Python workers.
"""

from __future__ import annotations

import hashlib
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from thresher.scratch import stored

DIMENSION, GRAM = 1024, 4
#: N-grams whose bins a worker remembers.
KNOWN = 200_000


def bins(form: Column, dimension: int = DIMENSION, gram: int = GRAM) -> Column:
    """The bin of each n-gram of a text, an array; none for null text and text shorter than one n-gram."""
    bits = dimension.bit_length() - 1
    if dimension == 1 << bits and bits <= 28:  # the last digits tell the remainder
        digits = max(1, -(-bits // 4))
        number = lambda g: F.conv(F.substring(F.md5(g), 9 - digits, digits), 16, 10).cast("int")
    else:
        number = lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long")
    grams = F.regexp_extract_all(form, F.lit(f"(?s)(?=(.{{{gram}}}))."), F.lit(1)).cast("array<binary>")
    found = F.transform(grams, lambda g: (number(g) % dimension).cast("int"))
    return F.coalesce(found, F.array().cast("array<int>"))


class _Known(dict):
    """The bin of each n-gram that was asked for."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, g: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[g] = found = int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % self.dimension
        return found


def bins_in_batches(form: Column, dimension: int = DIMENSION, gram: int = GRAM) -> Column:
    """The same as `bins`, by Python workers that hash an n-gram once: quicker where texts are alike and the result is stored."""

    def run(texts: pa.Array) -> pa.Array:
        known, flat, ends = _Known(dimension), array("i"), array("i", [0])
        for t in texts.to_pylist():
            if t:
                flat.extend([known[t[i : i + gram]] for i in range(len(t) - gram + 1)])
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.asarray(ends), pa.int32()), pa.array(np.asarray(flat), pa.int32()))

    return F.arrow_udf(run, "array<int>").asNondeterministic()(form)


class WeightedEmbedding:
    """A model in a folder of any store that Spark reads; `fit` makes it, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.dimension, self.gram, self.fragments = about["dimension"], about["gram"], about["fragments"]

    @staticmethod
    def _binned(rows: DataFrame, form: str, dimension: int, gram: int) -> Column:
        """The bins of a column of texts, or of one that holds them already."""
        return F.coalesce(form, F.array().cast("array<int>")) if rows.schema[form].dataType == ArrayType(IntegerType()) else bins(F.col(form), dimension, gram)

    @classmethod
    def fit(cls, rows: DataFrame, form: str, path: str, dimension: int = DIMENSION, gram: int = GRAM) -> WeightedEmbedding:
        """Count in how many rows each bin occurs; null forms count as rows without an n-gram.

        Here and in `embed` the forms may be texts or their `bins` of the same
        dimension and n-gram, which are worked out once if they are stored.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        held = rows.select(F.explode(F.array_distinct(cls._binned(rows, form, dimension, gram))).alias("bin"))
        held.groupBy("bin").agg(F.count("*").alias("held_by")).coalesce(1).write.parquet(f"{path}/bins")  # as many rows as bins at most
        spark.createDataFrame([(dimension, gram, rows.count())], "dimension int, gram int, fragments long").write.parquet(f"{path}/about")
        return cls(spark, path)

    @property
    def weights(self) -> DataFrame:
        """bin and weight; a bin that no row fell into has the weight of one that none holds."""
        return self.spark.read.parquet(f"{self.path}/bins").select("bin", (F.log((1 + self.fragments) / (1 + F.col("held_by"))) + 1).alias("weight"))

    def embed(self, rows: DataFrame, form: str, key: str) -> DataFrame:
        """key, bin and value of the components that aren't zero, of vectors of length one; rows with one key are one text after the other.

        Null keys and forms without an n-gram have no component; an empty
        table gives no row. A row whose key no other has is counted where it
        lies; `rows` is read twice to tell which these are, so it should be
        stored. For the others counting starts before the shuffle.
        """
        rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), self._binned(rows, form, self.dimension, self.gram).alias("bins"))
        repeated = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
        if repeated.isEmpty():
            return self._alone(rows).withColumnRenamed("key", key)
        alone = self._alone(rows.join(repeated, "key", "left_anti"))
        return alone.unionByName(self._together(rows.join(repeated, "key", "left_semi"))).withColumnRenamed("key", key)

    def _alone(self, rows: DataFrame) -> DataFrame:
        """Components of texts each by itself, without a shuffle."""
        known = {r["bin"]: r["weight"] for r in self.weights.collect()}  # as many as bins at most
        unseen = math.log(1.0 + self.fragments) + 1
        weights = F.lit(np.array([known.get(b, unseen) for b in range(self.dimension)]))

        def value(n: Column, b: Column) -> Column:
            return n * F.get(weights, b)

        def valued(s: Column, own: Column, at: Column) -> Column:
            last = F.size(s) + 1
            return F.transform(own, lambda b, k: F.struct(b.alias("bin"), value(F.coalesce(F.get(at, k + 1), last) - F.get(at, k), b).alias("value")))

        def measured(values: Column) -> Column:
            return F.struct(values.alias("all"), F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, v: t + v["value"] * v["value"])).alias("length"))

        # bins are in order, so as many lie before one as before its place; each step is bound to a variable, so that it is worked out once
        bound = lambda x, f: F.transform(F.array(x), f)[0]
        placed = lambda s, own: bound(F.transform(own, lambda b: F.array_position(s, b)), lambda at: bound(valued(s, own, at), measured))
        parts = bound(F.sort_array("bins"), lambda s: bound(F.array_distinct(s), lambda own: placed(s, own)))
        whole = rows.select("key", parts.alias("whole")).select("key", F.explode("whole.all").alias("c"), F.col("whole.length").alias("length"))
        return whole.select("key", "c.bin", (F.col("c.value") / F.col("length")).alias("value"))

    def _together(self, rows: DataFrame) -> DataFrame:
        """Components of the texts of keys that several rows have."""
        counted = rows.select("key", F.explode("bins").alias("bin")).groupBy("key", "bin").agg(F.count("*").alias("n"))
        unseen = F.log(F.lit(1.0 + self.fragments)) + 1
        valued = counted.join(F.broadcast(self.weights), "bin", "left").select("key", "bin", (F.col("n") * F.coalesce("weight", unseen)).alias("value"))
        # a key has as many rows as there are bins at most
        whole = valued.groupBy("key").agg(F.collect_list(F.struct("bin", "value")).alias("all"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
        return whole.select("key", F.explode("all").alias("c"), "length").select("key", "c.bin", (F.col("c.value") / F.col("length")).alias("value"))
