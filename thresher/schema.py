"""The row that extraction gives: one schema for every source."""

from __future__ import annotations

from pyspark.sql import types as T

FRAGMENT = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("processedCode", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
    ]
)
"""code: exact source of the function; start, end: its 1-based lines, both inclusive."""

SPANS = "array<struct<code:string,start:int,end:int>>"
"""What the parser gives for one file."""

CHANGED_FILES = T.StructType([T.StructField("path", T.StringType(), False)])
