"""From rows of file text to rows of functions."""

from __future__ import annotations

import logging
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from thresher.functions.eligibility import DEFAULT, REASONS, Rules, eligible, not_a_test, outside_folders, small_enough, turned_away
from thresher.functions.normalize import normalize_js, unify_newlines
from thresher.operators import jsparse
from thresher.schema import SPANS

log = logging.getLogger(__name__)


def _parse(texts: pa.Array) -> pa.Array:
    flat, ends = [], [0]
    for text in texts.to_pylist():
        try:
            flat += jsparse.fragments(text) if text else []
        except Exception as e:  # whatever is wrong with a file, the others go on
            log.warning("no functions read: %s", e)
        ends.append(len(flat))
    code, start, end = zip(*flat, strict=True) if flat else ((), (), ())
    rows = pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["code", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def functions_of(text: Column) -> Column:
    """Functions of a JavaScript text as array<struct<code, start, end>>.

    Null and empty text give an empty array, broken text the functions that
    can be told; one file never fails a job. Declared non-deterministic, since the
    optimizer would otherwise parse once more for a filter that it infers.
    """
    return F.arrow_udf(_parse, SPANS).asNondeterministic()(text)


def _look(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("line", pa.int32()), ("problem", pa.string())]))
    return pa.array([[{"line": n, "problem": what} for n, what in (jsparse.problems(t) if t else [])] for t in texts.to_pylist()], kind)


def problems(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each thing that is broken in a file: path, line, problem. Null text is one, at line 0."""
    found = files.select(F.col(path).alias("path"), F.col(text).isNull().alias("_none"), F.arrow_udf(_look, "array<struct<line:int,problem:string>>").asNondeterministic()(F.col(text)).alias("_p"))
    undecoded = F.array(F.struct(F.lit(0).alias("line"), F.lit("not text").alias("problem")))
    return found.select("path", F.explode(F.when(F.col("_none"), undecoded).otherwise(F.col("_p"))).alias("_p")).select("path", "_p.line", "_p.problem")


def decoded(content: Column) -> Column:
    """File bytes as text with LF line ends. Bytes that are not UTF-8 become replacement characters."""
    return unify_newlines(F.make_valid_utf8(content.cast("string")))


def judged_files(files: DataFrame, folders: Iterable[str] = (), rules: Rules = DEFAULT, observation: Observation | None = None) -> DataFrame:
    """All rows of a file scan with `text` and `reason`, why the file is turned away; null where it is analysed.

    An observation gets the number of files, of analysed ones, and of those
    turned away for each reason, counted in the pass in which the rows are
    used. Unlike `eligible_files`, this keeps every file, so the content of all
    is read; one too large whose content a source has left out is too large.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = decoded(F.col("content"))
    seen = F.when(valid, text).otherwise(F.replace(text, F.lit("\ufffd"), F.lit("")))
    large = F.when(~small_enough(F.col("length"), rules) & F.col("content").isNull(), "too large")
    rows = files.withColumn("reason", F.coalesce(F.when(not_a_test(F.col("path"), rules) & outside_folders(F.col("path"), (*rules.folders, *folders)), large), turned_away(F.col("path"), seen, F.col("length"), folders, rules)))
    rows = rows.withColumn("text", F.when(valid & F.col("reason").isNull(), text))
    if observation is None:
        return rows
    counts = [F.count_if(F.col("reason") == why).alias(why) for why in REASONS]
    return rows.observe(observation, F.count("*").alias("files"), F.count_if(F.col("reason").isNull()).alias("analysed"), *counts)


def eligible_files(files: DataFrame, folders: Iterable[str] = (), rules: Rules = DEFAULT) -> DataFrame:
    """Rows of a file scan (path, length, content) that are to be analysed.

    Adds `text`; invalid bytes are left out of the sample that the rules see,
    as a lenient reader would. Conditions on path and length alone come first,
    so they reach the scan.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = decoded(F.col("content"))
    seen = F.when(valid, text).otherwise(F.replace(text, F.lit("\ufffd"), F.lit("")))
    strict = F.when(valid, text)
    rows = files.where(small_enough(F.col("length"), rules) & not_a_test(F.col("path"), rules))
    return rows.where(eligible(F.col("path"), seen, F.col("length"), folders, rules)).withColumn("text", strict)


def chunks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each file with all its functions, none at all included.

    Columns: path, fragments (code, start, end, processedCode).
    """
    found = files.select(F.col(path).alias("path"), functions_of(F.col(text)).alias("_found"))
    whole = F.transform("_found", lambda f: F.struct(f["code"].alias("code"), f["start"].alias("start"), f["end"].alias("end"), normalize_js(f["code"]).alias("processedCode")))
    return found.select("path", whole.alias("fragments"))


def fragments(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each function: code, start, end, processedCode, path. Nested functions overlap."""
    found = files.select(F.col(path).alias("path"), functions_of(F.col(text)).alias("_found")).select("path", F.explode("_found").alias("_f"))
    return found.select("_f.code", "_f.start", "_f.end", normalize_js(F.col("_f.code")).alias("processedCode"), "path")
