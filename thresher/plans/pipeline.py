"""The whole analysis: changed files, eligible ones, their functions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from thresher.functions.eligibility import DEFAULT, Rules
from thresher.operators import fragments as op
from thresher.scratch import fresh, stored
from thresher.sources import files, git

#: Files of one batch, as far as batches matter at all.
BATCH_SIZE = 50


#: Files that a task parses, about: a task lasts seconds, however large the table.
TASK_FILES = 50_000


def spread(rows: DataFrame, workers: int | None = None, files_: int | None = None) -> DataFrame:
    """`rows` dealt to `workers` tasks, all cores by default, and to more where each would have over about TASK_FILES of `files_` rows; else as they are.

    Unless it is given, the number of rows is counted, which for a scan of
    columns costs no more than its footers.
    """
    most = rows.count() if files_ is None else files_
    tasks = max(workers or rows.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_FILES))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def analyse(found: DataFrame, folders: Iterable[str] = (), rules: Rules = DEFAULT, workers: int | None = None) -> DataFrame:
    """Chunks of the eligible files of a scan: path, fragments.

    No shuffle, unless the scan gives less than `workers` partitions, if that
    is given: then eligible files are dealt to so many, or more if these are
    large, before they are parsed.
    """
    files_ = op.eligible_files(found, folders, rules)
    return op.chunks(files_ if workers is None else spread(files_.select("path", "text"), workers, found.count()))


def analyse_evenly(found: DataFrame, tasks: int, folders: Iterable[str] = (), rules: Rules = DEFAULT) -> DataFrame:
    """As `analyse`, with eligible files dealt to tasks of about equal bytes, so that large ones don't meet in one."""
    files_ = op.eligible_files(found, folders, rules).select("path", "length", "text")
    return op.chunks(by_bytes(files_, "path", "length", tasks))


def analyse_changed(spark: SparkSession, cwd: str | None = None, folders: Iterable[str] = (), rules: Rules = DEFAULT) -> DataFrame:
    """Chunks of the files that git names as changed."""
    root = git.work_tree(cwd)
    paths = git.changed_paths(cwd) if root else []
    return analyse(files.read_listed(spark, paths, root or "/", rules.max_bytes), folders, rules)


def analyse_tree(spark: SparkSession, root: str, folders: Iterable[str] = (), rules: Rules = DEFAULT, workers: int | None = None) -> DataFrame:
    """Chunks of all JavaScript files below a folder of any store."""
    return analyse(files.relative(files.scan(spark, root), root), folders, rules, workers)


def rows_of(chunks: DataFrame) -> DataFrame:
    """Chunks as one row for each function, in the public column order."""
    return chunks.select(F.explode("fragments").alias("_f"), "path").select("_f.code", "_f.start", "_f.end", "_f.processedCode", "path")


def stream(chunks: DataFrame) -> Iterator[Row]:
    """Chunks one by one, a partition in memory at a time."""
    return chunks.toLocalIterator(prefetchPartitions=True)


def numbered(rows: DataFrame, key: str, weight: str | None = None, number: str = "number", before: str = "before") -> DataFrame:
    """`rows` with how many rows come before each by the order of an orderable key, and the sum of `weight` over them.

    Nulls of the key come first; rows with equal keys follow each other in any
    order. A null weight counts as 0. Rows are dealt by ranges of sampled
    bounds, where a key that many rows share spreads over as many parts as it
    takes; numbers inside a part and sums over the parts before it make the
    whole, so no task has more than its part, whatever the keys. An empty
    table stays empty. Columns named `number` or `before` are replaced.
    """
    rows = rows.select(*[c for c in rows.columns if c not in (number, before)])
    part, at, amount, first = fresh(rows, "_part", "_at", "_amount", "_first")
    order = [F.col(key).asc_nulls_first(), F.col(at)]
    dealt = rows.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # ids grow along the order, by one inside a part; written, so that they hold from here on
    dealt = stored(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id()), "numbered")
    amount_of = F.coalesce(F.col(weight), F.lit(0)).cast("long") if weight else F.lit(0).cast("long")
    sums = dealt.groupBy(part).agg(F.count("*").alias("n"), F.sum(amount_of).alias("w"))
    # one row for each part, of which there are as many as tasks
    parts = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select(part, (F.sum("n").over(parts) - F.col("n")).alias(first), (F.sum("w").over(parts) - F.col("w")).alias(amount))
    own = F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    out = dealt.join(F.broadcast(starts), part)
    if weight is None:
        return out.select(*rows.columns, own.alias(number))
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(*rows.columns, own.alias(number), (F.col(amount) + F.sum(amount_of).over(inside) - amount_of).alias(before))


def batch_numbers(rows: DataFrame, key: str, size: int = BATCH_SIZE) -> DataFrame:
    """`rows` with the batch each is in by the order of an orderable key; nulls come first, ties in any order."""
    kept = rows.select(*[c for c in rows.columns if c != "batch"])
    (nth,) = fresh(kept, "_nth")
    return numbered(kept, key, number=nth).select(*kept.columns, F.floor(F.col(nth) / F.lit(size)).alias("batch"))


def by_bytes(rows: DataFrame, key: str, length: str, tasks: int) -> DataFrame:
    """`rows` dealt to `tasks` partitions of about equal bytes, neighbours by key together.

    A row goes to the task in which the middle of its bytes falls, so a task
    has at most its share and one row more. Null lengths weigh nothing.
    """
    total = rows.agg(F.sum(F.col(length).cast("long"))).first()[0] or 0
    nth, start = fresh(rows, "_nth", "_start")
    placed = numbered(rows, key, length, nth, start)
    middle = F.col(start) + F.coalesce(F.col(length), F.lit(0)) / 2
    task = F.least(F.floor(middle * tasks / F.lit(max(1, total))), F.lit(tasks - 1)).cast("int")
    return placed.repartitionById(tasks, task).select(*rows.columns)


def worker_count(cores: Column, files_: Column, size: int = BATCH_SIZE) -> Column:
    return F.least(cores.cast("long"), F.lit(size).cast("long"), files_.cast("long"))
