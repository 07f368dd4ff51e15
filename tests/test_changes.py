"""Changed files of scratch repositories, as batches and as a stream of commits."""

import subprocess

import pytest

from thresher.operators import fragments as op
from thresher.sources.changes import changes, stream_changes
from thresher.streaming.files import stream_commits


def git(folder, *args):
    return subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def commit(folder, message="m"):
    git(folder, "add", "-A")
    git(folder, "commit", "-q", "-m", message)
    return git(folder, "rev-parse", "HEAD")


@pytest.fixture
def repository(tmp_path):
    folder = tmp_path / "repo"
    (folder / "sub").mkdir(parents=True)
    git(folder, "init", "-q")
    for name in ("a.js", "sub/b é.js", "sub/gone.js", "other.txt"):
        (folder / name).write_text(f"x = {{ m() {{ return '{name}'; }} }};\n")
    commit(folder)
    return folder


def rows(df):
    return sorted((r.path, r.length, None if r.content is None else bytes(r.content).decode()) for r in df.collect())


def test_work_tree(spark, repository):
    (repository / "a.js").write_text("changed\n")
    (repository / "sub/b é.js").write_text("y" * 50)
    (repository / "sub/gone.js").unlink()
    (repository / "new.js").write_text("untracked")
    found = changes(spark, cwd=str(repository / "sub"), max_bytes="20", files="1")
    assert rows(found) == [("sub/b é.js", 50, None)]
    assert rows(changes(spark, cwd=str(repository), max_bytes="20")) == [("a.js", 8, "changed\n"), ("sub/b é.js", 50, None)]


def test_between_commits(spark, repository):
    first = git(repository, "rev-parse", "HEAD")
    (repository / "a.js").write_text("second\r\n")
    (repository / "sub/gone.js").unlink()
    (repository / "empty.js").write_text("")
    (repository / "long.js").write_text("z" * 999)
    second = commit(repository)
    (repository / "a.js").write_text("not committed")
    want = [("a.js", 8, "second\r\n"), ("empty.js", 0, ""), ("long.js", 999, None)]
    for files in ("1", "2", "100"):
        assert rows(changes(spark, cwd=str(repository), **{"from": first, "to": second, "files": files, "max_bytes": "100"})) == want
    assert rows(changes(spark, cwd=str(repository), **{"from": second, "to": second})) == []
    assert changes(spark, cwd=str(repository), **{"from": first}).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("options", [{}, {"from": "nowhere"}, {"timeout": "0.000001"}])
def test_failing_git_gives_no_rows(spark, tmp_path, repository, options):
    if not options:
        repository = tmp_path / "none"
        repository.mkdir()
    else:
        (repository / "a.js").write_text("changed\n")
    assert rows(changes(spark, cwd=str(repository), **options)) == []


def run(df, folder, out):
    query = df.writeStream.format("parquet").option("checkpointLocation", str(folder / "checkpoint")).option("path", str(out)).start()
    query.processAllAvailable()
    query.stop()


def test_a_stream_of_commits_goes_on_after_a_restart(spark, repository, tmp_path):
    out = tmp_path / "out"

    def read():
        found = rows(spark.read.schema("path string, length long, content binary").parquet(str(out)))
        return [f[2] for f in found]

    run(stream_changes(spark, cwd=str(repository)), tmp_path, out)
    assert len(read()) == 3
    (repository / "a.js").write_text("two")
    commit(repository)
    (repository / "c.js").write_text("three")
    commit(repository)
    run(stream_changes(spark, cwd=str(repository)), tmp_path, out)
    assert sorted(read())[0:2] == ["three", "two"] and len(read()) == 5
    run(stream_changes(spark, cwd=str(repository)), tmp_path, out)
    assert len(read()) == 5


def test_functions_of_commits(spark, repository, tmp_path):
    run(stream_commits(spark, str(repository)), tmp_path, tmp_path / "out")
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.path for r in found) == ["a.js", "sub/b é.js", "sub/gone.js"]
    batch = op.fragments(op.eligible_files(changes(spark, cwd=str(repository), **{"from": git(repository, "hash-object", "-t", "tree", "/dev/null")})))
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch.collect()))
