"""The files of a directory tree: discovery on the driver (metadata only), reading on executors."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.paths import extension, file_name, in_folder, join_path
from codeatlas.functions.tables import MAX_RETAINED_BYTES


def _pattern(line: str, base: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern on the path below the root, negated, folders only) of one ignore rule."""
    s = line.rstrip("\n").rstrip("\r")
    s = s if s.endswith("\\ ") else s.rstrip(" ")
    if not s or s.startswith("#"):
        return None
    negated = s.startswith("!")
    s = s[1:] if negated else s.removeprefix("\\") if s[:2] in ("\\#", "\\!") else s
    folders = s.endswith("/")
    s = s.rstrip("/")
    anchored = "/" in s
    out, i = "", 0
    s = s.removeprefix("/")
    while i < len(s):
        c = s[i]
        if s.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if s.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (j := s.find("]", i + 2)) > 0:
            out, i = out + "[" + s[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            continue
        if c == "\\" and i + 1 < len(s):
            out, i = out + re.escape(s[i + 1]), i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    prefix = re.escape(base + "/") if base else ""
    return re.compile(prefix + ("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders


class Ignore:
    """Rules of ignore files; the last one that meets a path decides, deeper files later."""

    def __init__(self) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []

    def extended(self, folder: str, base: str) -> Ignore:
        out = Ignore()
        out.rules = self.rules
        for name in (".gitignore", ".ignore"):
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    out.rules = out.rules + [p for line in f if (p := _pattern(line, base))]
            except OSError:
                pass
        return out

    def ignored(self, path: str, is_folder: bool) -> bool:
        for p, negated, folders in reversed(self.rules):
            if (is_folder or not folders) and p.match(path):
                return not negated
        return False


def walk(root: str) -> Iterator[tuple[str, int]]:
    """(path below the root, bytes) of files that no rule ignores; hidden entries are skipped."""

    def down(base: str, ignore: Ignore) -> Iterator[tuple[str, int]]:
        folder = os.path.join(root, base) if base else root
        ignore = ignore.extended(folder, base)
        for e in os.scandir(folder):
            path = f"{base}/{e.name}" if base else e.name
            if e.name.startswith(".") or e.is_symlink() or ignore.ignored(path, e.is_dir()):
                continue
            if e.is_dir():
                yield from down(path, ignore)
            elif e.is_file():
                yield path, e.stat().st_size

    start, at = Ignore(), os.path.abspath(root)
    above = []
    while os.path.dirname(at) != at:  # a repository's ignore files above the root count as well
        if os.path.exists(os.path.join(at, ".git")):
            break
        above.append(at)
        at = os.path.dirname(at)
    yield from down("", start)


def discover(spark: SparkSession, root: str, extensions: list[str] = (), folders: list[str] = (), files: list[str] = ()) -> DataFrame:
    """(path, name, ext, bytes) of the eligible files: ``lock`` files, listed extensions (in any
    case), folders and exact paths are left out. Filters run before any file is opened."""
    table = spark.createDataFrame(list(walk(root)), "path string, bytes long")
    table = table.select("path", file_name("path").alias("name"), extension("path").alias("ext"), "bytes")
    table = table.where(F.coalesce(F.col("ext") != "lock", F.lit(True)))
    if extensions:
        table = table.where(~F.coalesce(F.lower("ext").isin([e.lower() for e in extensions]), F.lit(False)))
    for f in folders:
        table = table.where(~in_folder("path", f, os.path.basename(os.path.abspath(root))))
    if files:
        table = table.where(~F.col("path").isin(list(files)))
    return table


def read(manifest: DataFrame, root: str, open_file: Callable[[str], bytes] | None = None, bytes_per_task: int = 64 << 20) -> DataFrame:
    """Adds ``content``: the file's bytes up to 8 MiB, null beyond; lines and bytes are counted
    either way. The root must be readable by the workers (a shared folder on a cluster)."""

    def load(path: str) -> tuple[bytes | None, int, int]:
        if open_file:
            data = open_file(path)
            return (data if len(data) <= MAX_RETAINED_BYTES else None), *_count([data])
        with open(os.path.join(root, path), "rb") as f:
            head = f.read(MAX_RETAINED_BYTES + 1)
            if len(head) <= MAX_RETAINED_BYTES:
                return head, *_count([head])

            def rest():
                yield head
                while part := f.read(1 << 20):
                    yield part

            return None, *_count(rest())

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in it:
            for i in range(0, len(d), 64):
                part = d.iloc[i : i + 64].copy()
                part["content"], part["lines"], part["bytes"] = zip(*map(load, part["path"]), strict=True)
                yield part[["path", "name", "ext", "bytes", "lines", "content"]]

    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, min(manifest.sparkSession.sparkContext.defaultParallelism * 64, -(-total // bytes_per_task)))
    return manifest.select("path", "name", "ext", "bytes").repartition(int(tasks)).mapInPandas(run, "path string, name string, ext string, bytes long, lines long, content binary")


def _count(parts) -> tuple[int, int]:
    lines = size = 0
    last = b"\n"
    for p in parts:
        lines, size, last = lines + p.count(b"\n"), size + len(p), p[-1:] or last
    return lines + (size > 0 and last != b"\n"), size


def pre_scan(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Statistics of metadata only, without user filters: by extension, by folder, in total, and
    top-level folders without an eligible file."""
    files = discover(spark, root)
    from codeatlas.operators.hierarchy import rollup

    tops = spark.createDataFrame([(e.name,) for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".")], "folder string")
    folders = rollup(files, "path", F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"), root=False)
    return {
        "extensions": files.groupBy(F.coalesce(F.lower("ext"), F.lit("")).alias("ext")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes")),
        "folders": folders,
        "total": files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes")),
        "excluded": tops.join(folders, "folder", "left_anti"),
    }


__all__ = ["discover", "join_path", "pre_scan", "read", "walk"]
