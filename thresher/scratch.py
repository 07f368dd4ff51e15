"""Tables between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. In local mode alone a temporary folder stands in for it where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="thresher-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path there that nothing has used."""
    return f"{folder(spark)}/thresher-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written there and read back: what comes later rereads files, and an executor's loss runs nothing before them again."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Keys that `spread_join` may take for hot, which it broadcasts: no other has more than this part of all rows.
HOT_KEYS = 1024


def spread_join(many: DataFrame, few: DataFrame, key: str, each: int = 4096) -> DataFrame:
    """Inner join of `many` and `few` on a column of both; a key with over `each` rows of `many` is dealt to several tasks.

    Rows of `few` for such a key go to all its tasks. `many` is read twice, so
    it should be stored. Null keys meet nothing.
    """
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("_n") > each).select(key, F.ceil(F.col("_n") / each).cast("int").alias("_salts")))
    own = F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_salts")), F.lit(0)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    left = many.join(hot, key, "left").withColumn("_salt", own).drop("_salts")
    right = few.join(hot, key, "left").withColumn("_salt", everywhere).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
