"""The column expressions against the rules restated with Python's `re`."""

import random
import re

import pytest
from pyspark.sql import functions as F

from thresher.functions import eligibility as el
from thresher.functions import normalize as nz

def without_line_comments(s):
    """One line after the other: what stands before the first two slashes, and a blank for the rest."""
    return "\n".join(line if "//" not in line else line[: line.index("//")] + " " for line in s.split("\n"))


def without_block_comments(s):
    """A scanner that is outside or inside; what is still inside at the end was no comment."""
    out, opened, i = [], None, 0
    while i < len(s):
        pair = s[i : i + 2]
        if opened is None and pair == "/*":
            opened, i = i, i + 2
        elif opened is not None and pair == "*/":
            opened, i = None, i + 2
            out.append(" ")
        else:
            if opened is None:
                out.append(s[i])
            i += 1
    return "".join(out) + (s[opened:] if opened is not None else "")


def plain_normal(s):
    kept = []
    for c in without_block_comments(without_line_comments(s)):
        if c != ";" and not c.isspace():
            kept.append(c)
    return "".join(kept)


# The rules' own patterns and limits, restated as the plain version to test against.
def plain_hits(s):
    lines = s.splitlines()[:10]
    return (
        "sourceMappingURL" in s,
        bool(re.search(r"\.min\.js$", s)),
        bool(re.search(r"^[^\\n]{500,}$", s)),
        bool(re.search(r"\]{3,}", s)),
        bool(re.search(r"\}{3,}", s)),
        max((len(x) for x in lines), default=0),
    )


def fuzz(n=1500, seed=5):
    rng = random.Random(seed)
    bits = ["//", "/*", "*/", ";", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "　", " ", " ", " ", "﻿", "a", "n", "\\", "é", "😀", "]]", "]", "}}", "}", ".min.js", "sourceMappingURL", '"', "x" * 250, "m" * 499, "m" * 501, "\t"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(n)]


CASES = [
    ('href: "http://sap.com",\n b', 'href:"http:b'),
    ("/* a // b */ keep /* c */ d", "/*a"),
    ("for(;;){}", "for(){}"),
    ('const x = "a b"', 'constx="ab"'),
    ('"/*" + y + "*/"', '""'),
    ("", ""),
    ("/* open", "/*open"),
]


def test_normal_form(spark):
    texts = fuzz() + [c[0] for c in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.out for r in df.select("i", nz.normalize_js(F.col("s")).alias("out")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == plain_normal(s), repr(s)
    for k, (_, expected) in enumerate(CASES):
        assert got[len(texts) - len(CASES) + k] == expected


def test_minification_rules(spark):
    texts = fuzz(seed=6) + ["a" * 600, "a" * 600 + "n", "a\n" * 300, "x.min.js", "x.min.js\n", "x.min.js\nfoo", "", "m" * 500, "m" * 501]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    s = F.col("s")
    rules = [el.has_source_map(s), el.ends_minified(s), el.is_dense(s), el.has_bracket_run(s), el.has_brace_run(s), el.longest_line(s)]
    for r in df.select("i", *[x.alias(f"r{k}") for k, x in enumerate(rules)]).collect():
        assert tuple(r)[1:] == plain_hits(texts[r.i]), repr(texts[r.i])


@pytest.mark.parametrize("path,kept", [("a.test.js", False), ("x/y/a.test.js", False), (".test.js", False), ("a.spec.js", True), ("x/test.js", True), ("a.test.jsx", True), ("A.TEST.JS", True)])
def test_test_paths(spark, path, kept):
    assert spark.range(1).select(el.not_a_test(F.lit(path))).first()[0] is kept


def test_eligible_combines_all_and_handles_nulls(spark):
    rows = [("a.js", "x", 1, True), ("a.test.js", "x", 1, False), ("a.js", "x", 1_000_000, True), ("a.js", "x", 1_000_001, False), ("lib/a.js", "x", 1, False), ("a.js", "}}}", 1, False), ("a.js", "m" * 501, 1, False), ("a.js", "n\n" * 10 + "m" * 501, 1, True), ("a.js", "x" + "n\n" * 3000 + "}}}", 1, True), (None, "x", 1, False), ("a.js", None, 1, False), ("a.js", "x", None, False), ("a.js", "", 0, True)]
    df = spark.createDataFrame(rows, "path string, text string, size long, expected boolean")
    for r in df.withColumn("got", el.eligible(F.col("path"), F.col("text"), F.col("size"), ["lib"])).collect():
        assert r.got == r.expected, r


def test_line_of(spark):
    df = spark.createDataFrame([("a\nb\nc", 0, 1), ("a\nb\nc", 2, 2), ("a\nb\nc", 5, 3), ("", 0, 1)], "s string, at int, line int")
    for r in df.withColumn("got", nz.line_of(F.col("s"), F.col("at"))).collect():
        assert r.got == r.line
