"""The normal form of a piece of JavaScript, as column expressions.

Comments, semicolons and all white space go. The rules are lexical and blind:
they act inside string literals too, and line comments go before block
comments. Classes are spelt out, since the white space and line ends of the
JVM's patterns are not those the rules mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' patterns, in the syntax that both Java and RE2 read.
LINE_COMMENT = r"//[^\n]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
WHITE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def unify_newlines(text: Column) -> Column:
    """CR LF and lone CR become LF, as text mode reads a file."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def drop_line_comments(code: Column) -> Column:
    return F.regexp_replace(code, LINE_COMMENT, " ")


def drop_block_comments(code: Column) -> Column:
    return F.regexp_replace(code, BLOCK_COMMENT, " ")


def drop_semicolons(code: Column) -> Column:
    return F.replace(code, F.lit(";"), F.lit(""))


def drop_white_space(code: Column) -> Column:
    return F.regexp_replace(code, WHITE_SPACE, "")


def normalize_js(code: Column) -> Column:
    """The normal form; null stays null. Different programs may share one."""
    return drop_white_space(drop_semicolons(drop_block_comments(drop_line_comments(code))))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a character offset: line ends before it, plus one."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
