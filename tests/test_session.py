import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["fragments_methods"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path, sf_small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 50" in done.stdout, done.stderr[-2000:]


def test_entry_imports_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_rest_works_without_the_training_data_operators(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


WITHOUT = """
import sys
class Refuse:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Refuse())
import __spark_entry__ as e
print("queries", len(e.queries()), len(e.oracle_sql()))
"""


def test_entry_works_without_what_only_some_queries_need():
    counts = []
    for absent in ("nothing", "xxhash", "thresher.llm"):
        done = subprocess.run([sys.executable, "-c", WITHOUT.format(absent=absent)], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        counts.append(int(done.stdout.split()[1]))
    assert counts[0] >= counts[1] == counts[2] > 0
