"""History of a repository, and its counts kept by HEAD."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from codeatlas.operators.churn import counts_from_log

_LOG = ["log", "--numstat", "--no-renames", "--format=%H"]


@dataclass
class Outcome:
    counts: DataFrame
    warning: str | None = None


def _git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, env=os.environ | {"LC_ALL": "C"}, errors="replace")


def head(root: str) -> tuple[str | None, str | None]:
    """(HEAD, warning): neither without git, outside a repository, or before the first commit."""
    try:
        inside = _git(root, "rev-parse", "--git-dir")
    except OSError:
        return None, None
    if inside.returncode:
        return None, None if "not a git repository" in inside.stderr else inside.stderr.strip()
    found = _git(root, "rev-parse", "--verify", "HEAD")
    if found.returncode:
        return None, None if "Needed a single revision" in found.stderr or "unknown revision" in found.stderr else found.stderr.strip()
    return found.stdout.strip(), None


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def churn(spark: SparkSession, root: str, cache: str | None = None) -> Outcome:
    """Commits for each path; read from a table kept for this project and HEAD where there is one.
    Failures are warnings, and counts are then empty or not kept."""
    none = spark.createDataFrame([], "path string, commits long")
    at, warning = head(root)
    if at is None:
        return Outcome(none, warning)
    kept = f"{cache}/churn/{fnv1a(os.path.abspath(root).encode()):016x}/{at}" if cache else None
    if kept:
        try:
            return Outcome(spark.read.schema(none.schema).parquet(kept))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                warning = f"churn cache can't be read: {str(e)[:200]}"
    log = _git(root, *_LOG)
    if log.returncode:
        return Outcome(none, log.stderr.strip())
    counts = counts_from_log(spark.createDataFrame([(x,) for x in log.stdout.split("\n")], "line string"))
    if kept:
        try:
            counts.write.mode("overwrite").parquet(kept)
        except Exception as e:
            warning = f"churn cache can't be written: {str(e)[:200]}"
    return Outcome(counts, warning)
