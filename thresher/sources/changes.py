"""Changed files of a git repository as a Spark source, for batches and streams.

    spark.dataSource.register(GitChanges)
    spark.read.format("git_changes").option("cwd", folder).load()
    spark.readStream.format("git_changes").option("cwd", folder).load()

Options: `cwd`, a folder of the repository that the driver and the executors
see (the process's own by default); `timeout` in seconds for each call of git;
`from` and `to`, two commits (a batch without `from` reads the work tree's
unstaged changes, a stream begins with `from`, or with all files); `pattern`
of paths (`*.js`); `files` in a partition (200); `max_bytes`, above which a
file keeps its length and loses its content.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from thresher.functions.eligibility import MAX_BYTES
from thresher.sources import git

SCHEMA = "path string, length long, content binary"


@dataclass
class Files(InputPartition):
    """Paths with the ids of their contents; no id stands for the file in the work tree."""

    root: str
    files: list[tuple[str, str]]


class _Repository:
    """What batches and streams have in common. Any failure of git gives no files, as for `git.changed_paths`."""

    def __init__(self, options: dict):
        self.cwd = os.path.abspath(options.get("cwd", "."))
        self.timeout = float(options.get("timeout", git.TIMEOUT))
        self.first, self.last = options.get("from"), options.get("to")
        self.pattern = options.get("pattern", "*.js")
        self.files = int(options.get("files", 200))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))

    def ask(self, *args: str) -> str | None:
        return git._git(list(args), self.cwd, self.timeout)

    def commit(self, name: str) -> str | None:
        found = self.ask("rev-parse", "--verify", "--quiet", f"{name}^{{commit}}")
        return found.strip() if found else None

    def nothing(self) -> str | None:
        """The id of the tree without files."""
        found = self.ask("hash-object", "-t", "tree", os.devnull)
        return found.strip() if found else None

    def changed(self, first: str | None, last: str | None) -> list[Files]:
        """Partitions of the files that differ between two commits, without deleted ones; between index and work tree without a first one."""
        root = git.work_tree(self.cwd, self.timeout)
        span = [first, last or "HEAD"] if first else []
        listed = self.ask("diff", "--raw", "-z", "--no-abbrev", "--no-renames", "--diff-filter=d", *span, "--", self.pattern) if root else None
        parts = (listed or "").split("\0")
        # ":modes old new status" and the path, one after the other
        found = [(path, what.split(" ")[3] if span else "") for what, path in zip(parts[::2], parts[1::2]) if not what.split(" ")[1].startswith("160000")]
        return [Files(root or "", found[at : at + self.files]) for at in range(0, len(found), self.files)]

    def read(self, part: Files) -> Iterator[tuple]:
        ids = [blob for _, blob in part.files if blob]
        if ids:
            yield from self._objects(part)
            return
        for path, _ in part.files:
            full = os.path.join(part.root, path)
            if os.path.isfile(full):
                size, content = os.path.getsize(full), None
                if size <= self.max_bytes:
                    with open(full, "rb") as f:
                        content = f.read()
                yield path, size, content

    def _objects(self, part: Files) -> Iterator[tuple]:
        """Contents from the object store: sizes first, then those that are small enough, one at a time."""
        ids = [blob for _, blob in part.files]
        run = lambda what, of: subprocess.run(["git", "cat-file", what], cwd=self.cwd, input="".join(f"{i}\n" for i in of).encode(), capture_output=True, timeout=self.timeout, check=True).stdout
        sizes = [int(line.split(b" ")[2]) for line in run("--batch-check", ids).splitlines()]
        small = [i for i, size in zip(ids, sizes) if size <= self.max_bytes]
        raw, at = run("--batch", small) if small else b"", 0
        for (path, _), size in zip(part.files, sizes):
            content = None
            if size <= self.max_bytes:
                at = raw.index(b"\n", at) + 1
                content = raw[at : at + size]
                at += size + 1
            yield path, size, content


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.of = _Repository(options)

    def partitions(self) -> list[Files]:
        return self.of.changed(self.of.first, self.of.last) or [Files("", [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.of.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are commits; a batch is what differs between two of them, so a restart goes on from the last one that was done."""

    def __init__(self, options: dict):
        self.of = _Repository(options)

    def initialOffset(self) -> dict:
        return {"commit": self.of.commit(self.of.first) if self.of.first else self.of.nothing()}

    def latestOffset(self) -> dict:
        return {"commit": self.of.commit(self.of.last or "HEAD") or self.initialOffset()["commit"]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        same = start["commit"] == end["commit"] or not start["commit"]
        return [] if same else self.of.changed(start["commit"], end["commit"])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.of.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to tell git."""


class GitChanges(DataSource):
    """path, length and content of changed files."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def changes(spark, **options):
    """A batch of changed files; options as above."""
    spark.dataSource.register(GitChanges)
    return spark.read.format("git_changes").options(**options).load()


def stream_changes(spark, **options):
    """A stream of the files that commits change; options as above."""
    spark.dataSource.register(GitChanges)
    return spark.readStream.format("git_changes").options(**options).load()
