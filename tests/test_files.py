"""Sources and the whole plan over files on disk and in git."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import thresher
from thresher import Rules
from thresher.operators import fragments as op
from thresher.plans import pipeline as pl
from thresher.sources import files, git
from thresher.streaming.files import stream_fragments

SCRIPT = "A.extend('n', {\n  a() { return 'é'; },\n  b: () => 2\n});\n"


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.js").write_text(SCRIPT, encoding="utf-8")
    (tmp_path / "sub" / "crlf.js").write_bytes(SCRIPT.replace("\n", "\r\n").encode())
    (tmp_path / "sub" / "é ü.js").write_text(SCRIPT, encoding="utf-8")
    (tmp_path / "bad.js").write_bytes(b"x = {a() {}} // \xff\xfe")
    (tmp_path / "broken.js").write_text("x = {a() {")
    (tmp_path / "empty.js").write_text("")
    (tmp_path / "a.test.js").write_text(SCRIPT)
    (tmp_path / "mini.js").write_text("x={a(){if(b){if(c){}}}};")
    (tmp_path / "mapped.js").write_text(SCRIPT + "//# sourceMappingURL=a.map")
    (tmp_path / "edge.js").write_text("x={a(){}}\n" + "n;\n" * 333_330)
    (tmp_path / "big.js").write_text("x={a(){}}\n" + "n;\n" * 333_331)
    (tmp_path / "note.txt").write_text(SCRIPT)
    return tmp_path


def test_tree(spark, tree):
    assert os.path.getsize(tree / "edge.js") == 1_000_000
    got = {r.path: [f.code for f in r.fragments] for r in pl.analyse_tree(spark, str(tree)).collect()}
    both = ["a() { return 'é'; }", "() => 2"]
    want = {"a.js": both, "sub/crlf.js": both, "sub/é ü.js": both, "bad.js": [], "broken.js": [], "edge.js": ["a(){}"]}
    assert got == want
    dealt = pl.analyse_tree(spark, str(tree), workers=64)
    assert dealt.rdd.getNumPartitions() == 64 and {r.path: [f.code for f in r.fragments] for r in dealt.collect()} == want


def test_rules_can_be_set(spark, tree):
    rules = Rules(suffixes=("edge.js",), folders=("sub",), max_bytes=2000, patterns=(r"\[broken\]", "if\\(b\\)"))
    assert {r.path for r in pl.analyse_tree(spark, str(tree), rules=rules).collect()} == {"a.js", "bad.js", "broken.js", "a.test.js"}
    assert {r.path for r in pl.analyse_tree(spark, str(tree), rules=Rules(max_line_length=10)).collect()} == {"edge.js", "broken.js"}


def test_problems_of_files(spark, tree):
    found = op.problems(op.eligible_files(files.relative(files.scan(spark, str(tree)), str(tree))))
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("bad.js", 0, "not text"), ("broken.js", 1, "a bracket is not closed"), ("broken.js", 1, "a bracket is not closed")]


def test_command_line(tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git")
    run = lambda *a: subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.js").write_text("x = 1;\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "a.js").write_text("x = {a() {}};\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "thresher", str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.strip() == "[{'code': 'a() {}', 'start': 1, 'end': 1, 'processedCode': 'a(){}', 'path': 'a.js'}]"


def test_public_names():
    assert all(hasattr(thresher, name) for name in thresher.__all__)


def test_listed_files_keep_empty_ones(spark, tree):
    got = pl.analyse(files.read_listed(spark, ["empty.js", "a.js", "", "not there.js"], str(tree))).collect()
    assert sorted((r.path, len(r.fragments)) for r in got) == [("a.js", 2), ("empty.js", 0)]


def test_rows_have_the_public_schema(spark, tree):
    rows = pl.rows_of(pl.analyse_tree(spark, str(tree)))
    assert rows.columns == ["code", "start", "end", "processedCode", "path"]
    found = sorted(tuple(r) for r in rows.where("path = 'sub/crlf.js'").collect())
    assert found == [("() => 2", 3, 3, "()=>2", "sub/crlf.js"), ("a() { return 'é'; }", 2, 2, "a(){return'é'}", "sub/crlf.js")]


def test_size_reaches_the_scan(spark, tree):
    plan = op.eligible_files(files.scan(spark, str(tree)))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,1000000)" in plan


def test_changed_files(spark, tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git")
    run = lambda *a: subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "d").mkdir()
    for name in ("a.js", "d/é.js", "gone.js", "same.js", "b.txt"):
        (tmp_path / name).write_text("x = 1;\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    for name in ("a.js", "d/é.js", "b.txt"):
        (tmp_path / name).write_text(SCRIPT, encoding="utf-8")
    (tmp_path / "new.js").write_text(SCRIPT)
    (tmp_path / "staged.js").write_text(SCRIPT)
    run("add", "staged.js")
    (tmp_path / "gone.js").unlink()
    assert sorted(git.changed_paths(str(tmp_path))) == ["a.js", "d/é.js", "gone.js"]
    assert sorted(r.path for r in git.changed_files(spark, str(tmp_path)).collect()) == ["a.js", "d/é.js", "gone.js"]
    for cwd in (tmp_path, tmp_path / "d"):
        chunks = {r.path: len(r.fragments) for r in pl.stream(pl.analyse_changed(spark, str(cwd)))}
        assert chunks == ({"a.js": 2, "d/é.js": 2} if cwd == tmp_path else {"d/é.js": 2})


def test_no_repository(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("GIT_CEILING_DIRECTORIES", str(tmp_path.parent))
    assert git.changed_paths(str(tmp_path)) == []
    assert git.work_tree(str(tmp_path)) is None
    assert pl.analyse_changed(spark, str(tmp_path)).collect() == []
    assert git.changed_paths(str(tmp_path), timeout=0.0) == []
    monkeypatch.setenv("PATH", "")
    assert git.changed_paths(str(tmp_path)) == []


def test_stream(spark, tree, tmp_path):
    query = stream_fragments(spark, str(tree)).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert spark.table("found").where("path = 'a.js'").count() == 2
    assert spark.table("found").where("path = 'a.test.js'").count() == 0


def test_nulls_and_empty_tables(spark):
    files_ = spark.createDataFrame([("a", None), (None, "x={a(){}}"), ("b", "")], "path string, text string")
    assert sorted((r.path or "", len(r.fragments)) for r in op.chunks(files_).collect()) == [("", 1), ("a", 0), ("b", 0)]
    assert op.fragments(files_.where("false")).collect() == []


def test_batches(spark):
    got = pl.batch_numbers(spark.range(0, 200_001, 2).select(F.col("id").alias("k")), "k").groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in got) == [(b, 50) for b in range(2000)] + [(2000, 1)]


def test_files_are_parsed_once(spark, tree):
    plan = pl.rows_of(pl.analyse_tree(spark, str(tree)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
