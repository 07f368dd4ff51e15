"""Runs over one tree, again and again."""

from pyspark.sql import Observation

from thresher.plans.incremental import analyse_again
from thresher.plans.pipeline import analyse
from thresher.sources import files


def write(folder, **texts):
    for name, text in texts.items():
        path = folder / f"{name}.js"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(df):
    return sorted((r.path, [tuple(f) for f in r.fragments]) for r in df.collect())


def test_only_new_contents_are_parsed(spark, tmp_path):
    tree, state = tmp_path / "tree", str(tmp_path / "state")
    write(tree, a="x = { m() { return 1; } };\n", b="y = { n() {}, o: () => 2 };\n", c="x = { m() { return 1; } };\n", bad=b"x = '\xff';\n", none="z\n")

    def run():
        found = files.relative(files.scan(spark, str(tree)), str(tree))
        counts = Observation()
        got = rows(analyse_again(found, state, observation=counts))
        assert got == rows(analyse(found))
        return counts.get["parsed"], got

    first, got = run()
    assert first == 3 and [p for p, _ in got] == ["a.js", "b.js", "bad.js", "c.js", "none.js"]  # a and c are alike, one isn't text
    assert run() == (0, got)
    write(tree, b="y = { changed() {} };\n", moved="y = { n() {}, o: () => 2 };\n")
    (tree / "a.js").unlink()
    second, got = run()
    assert second == 1 and [p for p, _ in got] == ["b.js", "bad.js", "c.js", "moved.js", "none.js"]
    assert run()[0] == 0


def test_no_files(spark, tmp_path):
    found = spark.createDataFrame([], "path string, length long, content binary")
    assert analyse_again(found, str(tmp_path / "state")).collect() == []
    assert analyse_again(found, str(tmp_path / "state")).collect() == []
