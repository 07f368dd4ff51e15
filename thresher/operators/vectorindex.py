"""A stored index of vectors: cells as partitions of a table, probed by cosine similarity.

The cells' centres are fitted on a bounded sample; every row goes to the cell
of its nearest centre and lies there in packed blocks, so a lookup reads the
folders of the cells it probes and no others. A lookup either probes a stated
number of cells, or is exact: after a first round in the nearest cells it goes
to those which, by their radius, may hold anything better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.operators.similarity import PACK, best_pairs, packed, unit
from thresher.scratch import spread_join, stored

#: Cells, rows that their centres are fitted on at most, and rounds of that.
CELLS, SAMPLE, ROUNDS = 64, 20_000, 10
#: Vectors in a stored block, queries in one, and tasks that write a cell.
BLOCK, QUERIES, SPLIT = 4096, 1024, 8
#: Cells in the first round of an exact lookup.
FIRST = 2
#: What rounding may add to an angle.
MARGIN = 1e-6


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors, of length one; the first ones are far from one another."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)) and near.min() < 1 - MARGIN:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _wide(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors):
        row[: min(dim, len(v))] = v[:dim]
    return out


class VectorIndex:
    """An index in a folder of any store that Spark reads; `build` makes it, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # one row for each cell
        self.dim = max((len(r.centre) for r in found), default=0)
        self.centres = _wide([r.centre for r in found], self.dim)
        self.reach = np.array([r.reach for r in found])

    @classmethod
    def build(cls, rows: DataFrame, key: str, vector: str, path: str, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
        """Index every row with a 64-bit key and a direction; null keys and vectors without one have no place.

        A shorter vector counts as filled up with zeros; repeated rows each
        have their place. The sample are the rows of least hash of their key.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        units = rows.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("unit")).where("id is not null and unit is not null")
        drawn = units.orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").toArrow().column("unit").to_pylist()
        dim = units.agg(F.max(F.size("unit"))).first()[0] or 0
        shared = spark.sparkContext.broadcast(fit_cells(_wide(drawn, dim), cells))

        def nearest(column: pa.Array) -> pa.Array:
            near = _wide(column.to_pylist(), dim) @ shared.value.T
            cell = near.argmax(axis=1) if near.shape[1] else np.zeros(len(near), dtype=np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(near)), cell], -1, 1)) if near.shape[1] else np.zeros(len(near))
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle)], ["cell", "angle"])

        placed = stored(units.select("id", "unit", F.arrow_udf(nearest, "struct<cell:int,angle:double>").asNondeterministic()("unit").alias("at")).select("id", "unit", "at.*"), "placed")
        dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPLIT))).sortWithinPartitions("cell")
        packed(dealt.select("id", "unit", "cell"), BLOCK, "cell").write.partitionBy("cell").parquet(f"{path}/blocks")
        reach = {r.cell: r.reach for r in placed.groupBy("cell").agg(F.max("angle").alias("reach")).collect()}
        known = [(k, [float(x) for x in c], float(reach.get(k, -1.0))) for k, c in enumerate(shared.value)]
        spark.createDataFrame(known, "cell int, centre array<double>, reach double").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def blocks(self, cells: list[int]) -> DataFrame:
        """The packed rows of some cells; the folders of others are not read."""
        read = self.spark.read.schema(PACK + ", cell int").parquet(f"{self.path}/blocks")
        return read.where(F.col("cell").isin(cells))

    def lookup(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, least: float = -1.0) -> DataFrame:
        """The k nearest rows of each query: query_id, neighbor_id, similarity, rank; exact, unless `probes` states how many cells are looked at.

        Similarities are rounded to six digits, ties go to the lesser key; none
        is below `least`, and a row is no neighbour of its own key. Null keys
        and vectors without a direction find nothing.
        """
        asked = queries.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("unit")).where("id is not null and unit is not null")
        asked = stored(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
        if probes is not None:
            return self._ranked(self._near(asked, self._cells(probes, least), k, least), k)
        if least > -1:
            return self._ranked(self._near(asked, self._cells(len(self.centres), least), k, least), k)
        first = stored(self._near(asked, self._cells(FIRST), k, least), "first")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
        floors = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("floor"))
        more = asked.join(floors, "id", "left").select("id", "unit", "q", F.coalesce("floor", F.lit(-1.0)).alias("floor"))
        return self._ranked(first.unionByName(self._near(more, self._cells(len(self.centres), skip=FIRST), k, least)), k)

    def _cells(self, probes: int, least: float = -1.0, skip: int = 0):
        """For vectors and what they have found, the nearest cells, without the first ones, which may hold anything as good."""
        centres, reach, dim = self.centres, self.reach, self.dim

        def choose(units: pa.Array, floors: pa.Array) -> pa.Array:
            out = []
            full = units.to_pylist()
            near = _wide(full, dim) @ centres.T
            # what of a longer vector lies beyond the index's dimension is at right angles to all of it
            angle = np.arccos(np.clip(near, -1, 1))
            best = np.cos(np.maximum(0, angle - reach[None, :] - MARGIN))
            order = np.argsort(-near, axis=1, kind="stable")
            for row, bound, floor in zip(order, best, floors.to_pylist()):
                mine = row[reach[row] >= 0][skip:probes]
                out.append(mine[bound[mine] >= max(floor, least) - MARGIN].tolist())
            return pa.array(out, pa.list_(pa.int32()))

        return F.arrow_udf(choose, "array<int>")

    def _near(self, asked: DataFrame, cells, k: int, least: float) -> DataFrame:
        floor = F.col("floor") if "floor" in asked.columns else F.lit(-1.0)
        goes = stored(asked.select("id", "unit", F.explode(cells("unit", floor)).alias("cell")), "goes")
        needed = [r.cell for r in goes.select("cell").distinct().collect()]  # as many as there are cells at most
        packs = packed(goes.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SPLIT))).sortWithinPartitions("cell"), QUERIES, "cell")
        sent = packs.select("cell", *[F.col(c).alias(f"q_{c}") for c in ("ids", "dim", "units")])
        found = best_pairs(spread_join(self.blocks(needed), sent, "cell", each=8).drop("cell"), k)
        return found.where(F.col("similarity") >= least)

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
