"""Why files are turned away, and that the reasons agree with the rules."""

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from thresher.functions import eligibility as el
from thresher.operators import fragments as op

CASES = [
    ("a.js", "x = 1;\n", None),
    (None, "x", "unreadable"),
    ("a.test.js", None, "test"),
    ("a/dist/b.js", "x", "folder"),
    ("a.js", None, "unreadable"),
    ("a.js", "//# sourceMappingURL=m ]]]", "source map"),
    ("a.js", "x.min.js\n", "minified end"),
    ("a.js", "x" * 500, "dense"),
    ("a.js", "a]]] }}}", "brackets"),
    ("a.js", "a}}}", "braces"),
    ("a.js", "debugger", "pattern"),
    ("a.js", "n" + "x" * 500, "long line"),
    ("a.js", "n\n" * 60, "too large"),
    ("a.js", "", None),
]
RULES = el.Rules(folders=("dist",), max_bytes=600, patterns=("debugger",))


def test_first_reason_of_each_case(spark):
    rules = el.Rules(folders=("dist",), max_bytes=119, patterns=("debugger",))
    small = [c for c in CASES if c[2] not in ("dense", "long line")]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(small)], "n int, path string, text string, want string")
    got = {r.n: r.reason for r in df.select("n", el.turned_away(F.col("path"), F.col("text"), F.octet_length("text"), (), rules).alias("reason")).collect()}
    assert got == {n: c[2] for n, c in enumerate(small)}
    df = spark.createDataFrame([(c[1],) for c in CASES if c[2] in ("dense", "long line")], "text string")
    assert [r[0] for r in df.select(el.turned_away(F.lit("a.js"), F.col("text"), F.octet_length("text"))).collect()] == ["dense", "long line"]


def test_no_reason_just_where_eligible(spark):
    rng = random.Random(5)
    bits = ["]", "}", "]]]", "n", "x" * 300, "\n", "debugger", "sourceMappingURL", ".min.js", "ok;"]
    rows = [(rng.choice(["a.js", "a.test.js", "dist/a.js", "src/a.js", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 5)))]), rng.choice([None, 5, 600, 601])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "path string, text string, size long")
    args = F.col("path"), F.col("text"), F.col("size")
    both = df.select(el.turned_away(*args, ("src0",), RULES).alias("why"), el.eligible(*args, ("src0",), RULES).alias("fits"))
    found = both.groupBy("fits", F.col("why").isNull().alias("none")).count().collect()
    assert {(r.fits, r.none) for r in found} == {(True, True), (False, False)}
    assert {r.why for r in both.select("why").distinct().collect()} - {None} <= set(el.REASONS)


def test_counts_come_with_the_rows(spark):
    rows = [(p, len(t.encode()), bytearray(t.encode())) for p, t, _ in CASES if p and t is not None] + [("bad.js", 3, bytearray(b"a\xff\n")), ("huge.js", 5_000_000, None), ("gone.js", 3, None)]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    counts = Observation()
    judged = op.judged_files(df, observation=counts, rules=RULES)
    found = op.chunks(judged.where("reason is null")).collect()
    analysed = op.eligible_files(df.where("content is not null"), (), RULES).count()
    assert len(found) == counts.get["analysed"] == analysed and counts.get["files"] == len(rows)
    assert counts.get["too large"] >= 1 and counts.get["unreadable"] == 1 and sum(counts.get[w] for w in el.REASONS) + analysed == len(rows)
    assert judged.where("path = 'bad.js'").first().text is None


def test_no_files(spark):
    df = spark.createDataFrame([], "path string, length long, content binary")
    assert op.judged_files(df).collect() == []
