"""Changed files of a git work tree."""

from __future__ import annotations

import logging
import subprocess

from pyspark.sql import DataFrame, SparkSession

from thresher.schema import CHANGED_FILES

log = logging.getLogger(__name__)

#: Seconds that git may take.
TIMEOUT = 300


def _git(args: list[str], cwd: str | None, timeout: float) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        log.warning("git took more than %s s", timeout)
        return None
    except OSError as e:
        log.warning("git could not be run: %s", e)
        return None
    if done.returncode:
        log.warning("git failed: %s", done.stderr.decode("utf-8", "replace").strip())
        return None
    return done.stdout.decode("utf-8", "surrogateescape")


def work_tree(cwd: str | None = None, timeout: float = TIMEOUT) -> str | None:
    """The root that paths are relative to, or None outside a work tree."""
    found = _git(["rev-parse", "--show-toplevel"], cwd, timeout)
    return found.rstrip("\n") if found else None


def changed_paths(cwd: str | None = None, timeout: float = TIMEOUT) -> list[str]:
    """Tracked `.js` files with unstaged changes at or below `cwd`, relative to the root.

    Names come as they are, whatever their characters. Staged and untracked
    files are not among them; deleted ones are. Any failure gives none.
    """
    found = _git(["diff", "--name-only", "-z", "--", "*.js"], cwd, timeout)
    return [p for p in (found or "").split("\0") if p]


def changed_files(spark: SparkSession, cwd: str | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """`changed_paths` as a DataFrame with the column path."""
    return spark.createDataFrame([(p,) for p in changed_paths(cwd, timeout)], CHANGED_FILES)
