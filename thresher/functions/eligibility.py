"""Which files are analysed, as column predicates over path, size and a sample of the text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and patterns of the rules.
MAX_BYTES = 1_000_000
SAMPLE_CHARS = 5000
MAX_LINES = 10
MAX_LINE_LENGTH = 500
EXCLUDED_SUFFIX = ".test.js"
SOURCE_MAP = "sourceMappingURL"
MINIFIED_END = r"\.min\.js\n?\z"
BRACKET_RUN = r"\]{3,}"
BRACE_RUN = r"\}{3,}"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@dataclass(frozen=True)
class Rules:
    """What an analyser may set: endings and folders of paths, limits, and further patterns that mark a sample as minified."""

    suffixes: tuple[str, ...] = (EXCLUDED_SUFFIX,)
    folders: tuple[str, ...] = ()
    max_bytes: int = MAX_BYTES
    sample_chars: int = SAMPLE_CHARS
    max_lines: int = MAX_LINES
    max_line_length: int = MAX_LINE_LENGTH
    patterns: tuple[str, ...] = ()


DEFAULT = Rules()


def sample_of(text: Column, rules: Rules = DEFAULT) -> Column:
    return F.substring(text, 1, rules.sample_chars)


def not_a_test(path: Column, rules: Rules = DEFAULT) -> Column:
    out = F.lit(True)
    for suffix in rules.suffixes:
        out = out & ~path.endswith(suffix)
    return out


def outside_folders(path: Column, folders: Iterable[str]) -> Column:
    """No component of the path is one of `folders`."""
    parts = F.split(path, "/")
    out = F.lit(True)
    for folder in folders:
        out = out & ~F.array_contains(parts, folder)
    return out


def has_source_map(sample: Column) -> Column:
    return sample.contains(SOURCE_MAP)


def ends_minified(sample: Column) -> Column:
    """The sample itself, not the file's name, ends in `.min.js`, perhaps with a line end."""
    return sample.rlike(MINIFIED_END)


def is_dense(sample: Column) -> Column:
    """At least 500 characters, none of them a backslash or the letter n. Line ends don't matter."""
    return (F.length(sample) >= 500) & ~sample.rlike(r"[\\n]")


def has_bracket_run(sample: Column) -> Column:
    return sample.rlike(BRACKET_RUN)


def has_brace_run(sample: Column) -> Column:
    return sample.rlike(BRACE_RUN)


def longest_line(sample: Column, rules: Rules = DEFAULT) -> Column:
    """Length of the longest of the first ten lines; 0 for an empty sample."""
    lines = F.slice(F.split(sample, LINE_BREAK), 1, rules.max_lines)
    return F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))


def not_minified(sample: Column, rules: Rules = DEFAULT) -> Column:
    hit = has_source_map(sample) | ends_minified(sample) | is_dense(sample) | has_bracket_run(sample) | has_brace_run(sample)
    for pattern in rules.patterns:
        hit = hit | sample.rlike(pattern)
    return ~hit & (longest_line(sample, rules) <= rules.max_line_length)


def small_enough(size: Column, rules: Rules = DEFAULT) -> Column:
    return size <= rules.max_bytes


def eligible(path: Column, text: Column, size: Column, folders: Iterable[str] = (), rules: Rules = DEFAULT) -> Column:
    """All rules together. A null path, text or size is not eligible.

    The sample is bound to a variable, so that it is taken once for all rules
    and not once for each.
    """
    fits = F.exists(F.array(sample_of(text, rules)), lambda sample: not_minified(sample, rules))
    return F.coalesce(not_a_test(path, rules) & outside_folders(path, (*rules.folders, *folders)) & small_enough(size, rules) & fits, F.lit(False))


#: Reasons in the order in which rules are asked; a file has the first that fits.
REASONS = ("unreadable", "test", "folder", "source map", "minified end", "dense", "brackets", "braces", "pattern", "long line", "too large")


def turned_away(path: Column, text: Column, size: Column, folders: Iterable[str] = (), rules: Rules = DEFAULT) -> Column:
    """Why a file is not eligible, one of REASONS; null for one that is, so it is null just where `eligible` holds.

    A null path, text or size is unreadable, unless a rule that needs nothing
    else has turned the file away before.
    """

    def of_sample(sample: Column) -> Column:
        more = F.lit(False)
        for pattern in rules.patterns:
            more = more | sample.rlike(pattern)
        why = F.when(has_source_map(sample), "source map").when(ends_minified(sample), "minified end").when(is_dense(sample), "dense")
        why = why.when(has_bracket_run(sample), "brackets").when(has_brace_run(sample), "braces").when(more, "pattern")
        return why.when(longest_line(sample, rules) > rules.max_line_length, "long line")

    minified = F.transform(F.array(sample_of(text, rules)), of_sample)[0]
    why = F.when(path.isNull(), "unreadable").when(~not_a_test(path, rules), "test").when(~outside_folders(path, (*rules.folders, *folders)), "folder")
    why = why.when(text.isNull() | size.isNull(), "unreadable").when(minified.isNotNull(), minified)
    return why.when(~small_enough(size, rules), "too large")
