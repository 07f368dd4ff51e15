"""What the operators of this subpackage share: scratch tables, memories of workers, labels."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents that lie in fewer partitions than there are cores are dealt to all."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. In local mode alone a temporary one stands in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="thresher-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: lineage ends here.

    A task that is lost later rereads the files, so an executor's loss never
    re-runs what came before, and row order inside the files is fixed.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/thresher-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = weakref.ref(out)
    return out


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As `stored`, bucketed by a key, so that what is grouped by it later isn't moved again.

    As many buckets as the session has shuffle partitions. The catalog knows
    the table only while it is written; its files stay in the shared folder.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/thresher-{name}-{uuid.uuid4().hex}"
    known = f"thresher_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(known)
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")
    _WRITTEN[path] = weakref.ref(out)
    return out


#: Scratch tables of this process, in the order they were written.
_WRITTEN: dict[str, weakref.ref] = {}


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def written() -> set[str]:
    """The scratch tables there are, for `discard`."""
    return set(_WRITTEN)


def discard(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Delete the scratch tables that an operator has written since `before`, but for those its result reads."""
    _delete(spark, [path for path, df in _WRITTEN.items() if path not in before and all(df() is not k for k in kept)])


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process, once its results have been written."""
    _delete(spark, list(_WRITTEN))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _WRITTEN[name]


#: The C library's call for that, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

_CACHES: dict[str, list] = {}
_OWNER = [""]


def worker_cache(owner: str, cache):
    """Register a cache that a worker keeps between batches for one operator. Returns it."""
    _CACHES.setdefault(owner, []).append(cache)
    return cache


def claim(owner: str) -> None:
    """Called by an operator on its batches: empties what other operators left in this worker.

    Workers live on from stage to stage, so their memories would add up.
    """
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for other, caches in _CACHES.items():
            if other != owner:
                for cache in caches:
                    cache.clear()
        pa.default_memory_pool().release_unused()
        gc.collect()
        if _TRIM is not None:
            _TRIM(0)  # what the allocator keeps for later goes back to the machine


def pieces_of(batches, rows: int = 128):
    """Batches, or data frames, of an iterator in pieces of so many rows, where what is made of a row is much larger than it."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows) if isinstance(batch, pa.RecordBatch) else batch.iloc[at : at + rows]


def held_out(doc_id: Column) -> Column:
    """True on the fold that no label or language may be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
