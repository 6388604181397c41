"""Index a directory tree: files, symbols, churn, calls, roles and rectangles as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas.functions import paths, tables
from codeatlas.operators import call_index as indexes
from codeatlas.operators import calls as call_ops
from codeatlas.operators import churn as churn_ops
from codeatlas.operators import hierarchy, intervals, pack
from codeatlas.plans.lineage import saved
from codeatlas.sources import git, manifest


@dataclass
class Index:
    root: str
    files: DataFrame
    nodes: DataFrame
    warnings: list[str] = field(default_factory=list)


_ITEMS = "file string, kind string, label string, path string, parent string, name string, byte_start long, byte_end long, signature string, doc string, measure long, src_order long, depth int"


def _chunks(text: str, ext: str) -> list[tuple[int, int, str]]:
    """(first line, end line, label) of a long text's chunks."""
    import re

    rows = text.split("\n")
    rows = [r.rstrip("\r") for r in (rows[:-1] if text.endswith("\n") else rows)]
    n = len(rows)
    if ext not in ("md", "markdown"):
        cuts = list(range(0, n, tables.CHUNK_LINES))
        return [(a, min(a + 60, n), f"{a + 1}–{min(a + 60, n)}") for a in cuts]
    head = [re.match(r" {0,3}#{1,6}[ \t]", r) is not None for r in rows]
    cuts, seen = [0], head[0]
    for i in range(1, n):
        if head[i] and seen or not head[i] and not rows[i].strip() and i - cuts[-1] >= tables.CHUNK_LINES:
            cuts.append(i)
        seen = seen or head[i]
    label = lambda a, b: rows[a].lstrip(" ").lstrip("#").strip() if head[a] else f"{a + 1}–{b}"
    return [(a, b, label(a, b)) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def _symbols(files: DataFrame) -> DataFrame:
    """Items and chunks of files (path, ext, lines, content, language): one pass over contents."""
    retained = set(tables.RETAINED_TEXT)

    def of(path: str, ext: str | None, lines: int, content: bytes | None, language: str | None) -> list[tuple]:
        from codeatlas.parse import registry, rows

        out: list[tuple] = []

        def add(items, parent: str, depth: int) -> None:
            for it in items:
                own = f"{parent}::{it.name}"
                out.append((path, "item", it.label, own, parent, it.name, it.start, it.end, it.signature, it.doc, rows(content, it.start, it.end), len(out), depth))
                add(it.children, own, depth + 1)

        if content is None:
            return out
        items = registry.parse(content, language)
        add(items, path, 1)
        if text := registry.doc(content, language):
            out.append((path, "doc", None, path, None, "", 0, 0, None, text, 0, 0, 0))
        if not items and lines > tables.CHUNK_LINES and (ext in retained or language in registry.PARSERS):
            try:
                parts = _chunks(content.decode("utf-8"), ext or "")
            except UnicodeDecodeError:
                return out
            if len(parts) > 1:
                at = [0]
                for row in content.split(b"\n"):
                    at.append(at[-1] + len(row) + 1)
                for i, (a, b, label) in enumerate(parts):
                    out.append((path, "chunk", None, f"{path}#{i}", path, label, at[a], min(at[b], len(content)), None, None, b - a, len(out), 1))
        return out

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ITEMS.split(", ")]
        for d in it:
            for r in d.itertuples(index=False):
                if found := of(r.path, r.ext, r.lines, r.content, r.language):
                    yield pd.DataFrame(found, columns=names)

    return files.select("path", "ext", "lines", "content", "language").mapInPandas(run, _ITEMS)


def content_fingerprint(content: Column) -> Column:
    """64-bit FNV-1a of a whole binary content as 16 hexadecimal digits; null for null, the
    offset basis for an empty one."""
    @F.pandas_udf("string")
    def fnv(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else f"{git.fnv1a(b):016x}")

    return fnv(content)


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, fingerprint) of retained contents: 64-bit FNV-1a, as hexadecimal digits."""
    kept = files.where(F.col("content").isNotNull() & (paths.is_retained_text("ext") | F.col("language").isNotNull()))
    return kept.select("path", content_fingerprint(F.col("content")).alias("fingerprint"))


def index(spark: SparkSession, root: str, extensions=(), folders=(), files=(), cache: str | None = None) -> Index:
    """The tree of a directory: folder, file, item and chunk nodes with rolled-up lines, ordinals
    that are unique in the tree, and churn."""
    listed = manifest.discover(spark, root, list(extensions), list(folders), list(files))
    read = manifest.read(listed, root).withColumn("language", paths.language("path")).cache()
    history = git.churn(spark, root, cache)
    counted, folder_churn = churn_ops.annotate(read.drop("content"), history.counts)

    none = {"label": F.lit(None).cast("string"), "signature": F.lit(None).cast("string"), "doc": F.lit(None).cast("string")}
    parent = lambda p: F.when(p.contains("/"), F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")
    file_nodes = counted.select("path", F.lit("file").alias("kind"), parent(F.col("path")).alias("parent"), "name", F.lit(0).cast("long").alias("byte_start"), F.col("bytes").alias("byte_end"), F.col("lines").alias("measure"), F.lit(0).cast("long").alias("src_order"), "commits", "churn", F.size(F.split("path", "/")).alias("depth")).withColumns(none)
    sums = hierarchy.rollup(read, "path", F.sum("lines").alias("measure"))
    top = os.path.basename(os.path.abspath(root))
    folder = sums.join(folder_churn, "folder")
    folder_nodes = folder.select(F.col("folder").alias("path"), F.lit("folder").alias("kind"), F.when(F.col("folder") != "", parent(F.col("folder"))).alias("parent"), F.when(F.col("folder") == "", top).otherwise(paths.file_name("folder")).alias("name"), F.lit(None).cast("long").alias("byte_start"), F.lit(None).cast("long").alias("byte_end"), "measure", F.lit(0).cast("long").alias("src_order"), "commits", "churn", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).alias("depth")).withColumns(none)
    symbols = _symbols(read)
    docs = symbols.where("kind = 'doc'").select("path", F.col("doc").alias("_doc"))
    file_nodes = file_nodes.join(docs, "path", "left").withColumn("doc", F.col("_doc")).drop("_doc")
    items = symbols.where("kind <> 'doc'").join(file_nodes.select(F.col("path").alias("file"), "commits", "churn", F.col("depth").alias("fd")), "file")
    items = items.withColumn("depth", F.col("depth") + F.col("fd")).drop("file", "fd")
    nodes = file_nodes.unionByName(folder_nodes).unionByName(items)
    nodes = hierarchy.sibling_ordinals(nodes, "parent", "name", "src_order")
    # preorder: the sort keys of a node's ancestors and its own, in one string
    make = F.col("path").rlike(r"(^|/)(Makefile|makefile|GNUmakefile)(::|$)|\.mk(::|$)") & (F.col("kind") == "item")
    nodes = nodes.withColumn("order", F.struct(F.regexp_replace(F.regexp_replace("path", "::", "\u0001"), "/", "\u0001"), F.when(make, F.col("src_order")).otherwise(0), "ordinal", "src_order"))
    nodes = nodes.withColumn("pre", F.row_number().over(Window.partitionBy(paths.file_part("path")).orderBy("order")))
    nodes = hierarchy.dedupe_ids(nodes, ["kind", "label", "path"], "ordinal", "pre").withColumn("ordinal", F.col("new_ordinal")).drop("new_ordinal")
    return Index(root, read, nodes, [w for w in [history.warning] if w])


def dump(found: Index) -> DataFrame:
    """One line for each node, in tree order: indent, kind, name, lines and churn."""
    kind = F.initcap(F.coalesce("label", "kind"))
    share = F.bround(F.col("churn").cast("float").cast("double") * 100, 0).cast("int")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), kind, F.lit(" "), F.col("name"), F.lit(" ["), F.col("measure").cast("string"), F.lit(" lines, churn "), F.col("commits").cast("string"), F.lit(" · p"), share.cast("string"), F.lit("]"))
    rank = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", "::|#", "/"), "/"))
    return found.nodes.orderBy(rank, "pre").select(line.alias("line"))


def functions(found: Index) -> DataFrame:
    """(path, ordinal, name, file, ext, byte_start, byte_end, ret, pre) of function items."""
    f = found.nodes.where("label = 'fn'").withColumn("file", paths.file_part("path")).withColumn("ext", paths.extension("path"))
    from codeatlas.functions.text import return_type

    return f.select("path", "ordinal", "name", "file", "ext", "byte_start", "byte_end", return_type("signature", "ext").alias("ret"), "pre")


def _by_file(found: Index, some: Column | None = None, center: str | None = None) -> DataFrame:
    """(file, ext, content, functions): the functions of each file in one row, so that a file's bytes
    are moved and parsed once for all of them. ``some`` is a condition on (path, content) of files;
    ``center`` leaves one function."""
    f = functions(found)
    f = f if center is None else f.where(F.col("path") == center)
    f = f.select("file", "ext", F.struct("path", "byte_start", "byte_end", paths.enclosing_class("path").alias("enclosing")).alias("f"))
    f = f.groupBy("file", "ext").agg(F.collect_list("f").alias("functions"))
    return f.join(found.files.where("content is not null").where(F.lit(True) if some is None else some).select(F.col("path").alias("file"), "content"), "file")


def calls(found: Index, some: Column | None = None, center: str | None = None) -> DataFrame:
    """(caller, name, site, site_end, receiver) of every function, of those in some files, or of one."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeatlas.parse import registry

        for d in it:
            out = [(f["path"], n, a, b, v) for r in d.itertuples(index=False) for f in r.functions for n, a, b, v in registry.calls(r.content, r.ext, int(f["byte_start"]), int(f["byte_end"]))]
            yield pd.DataFrame(out, columns=["caller", "name", "site", "site_end", "receiver"])

    return _by_file(found, some, center).select("ext", "content", "functions").mapInPandas(run, "caller string, name string, site long, site_end long, receiver string")


def type_bindings(found: Index, some: Column | None = None, center: str | None = None) -> DataFrame:
    """(caller, receiver, class) of every function (or some, as in ``calls``); class names and return types of the tree are
    gathered for each file by a join on the names that it holds."""
    f = functions(found)
    classes = found.nodes.where("label in ('class', 'struct', 'impl')").select("name").distinct()
    returns = call_ops.last_return_type(f)
    names = classes.select("name", F.lit(None).cast("string").alias("ret")).unionByName(returns)
    words = found.files.where("content is not null").where(F.lit(True) if some is None else some).select(F.col("path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"\w+"), F.lit(0)))).alias("name"))
    known = words.join(names, "name").groupBy("file").agg(F.collect_list(F.struct("name", "ret")).alias("known"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeatlas.parse import registry

        for d in it:
            out = []
            for r in d.itertuples(index=False):
                pairs = [(k["name"], k["ret"]) for k in (r.known if r.known is not None else [])]
                kinds, made = {n for n, t in pairs if t is None}, {n: t for n, t in pairs if t}
                for f in r.functions:
                    got = registry.bindings(r.content, r.ext, int(f["byte_start"]), int(f["byte_end"]), f["enclosing"], kinds, made)
                    out += [(f["path"], v, c) for v, c in got.items()]
            yield pd.DataFrame(out, columns=["caller", "receiver", "class"])

    rows = _by_file(found, some, center).join(known, "file", "left")
    return rows.select("ext", "content", "functions", "known").mapInPandas(run, "caller string, receiver string, class string")


def all_call_edges(found: Index) -> DataFrame:
    """Callees and callers of every function."""
    c = calls(found).select("caller", "name", "site", "receiver")
    return call_ops.edges(c, functions(found).select("path", "name"), type_bindings(found))


def resolve_calls(found: Index, center: str) -> DataFrame:
    """Callees and callers of one function. Only its own file is parsed for what it calls, and for who calls
    it only files that hold its name; nothing where there is no such function."""
    f = functions(found).select("path", "name", "file")
    me = f.where(F.col("path") == center).limit(1).collect()
    if not me:
        return call_ops.edges(calls(found, F.lit(False)).select("caller", "name", "site", "receiver"), f.select("path", "name"))
    own = F.col("path") == me[0]["file"]
    made = calls(found, own, center).select("caller", "name", "site", "receiver")
    out = call_ops.callees(made, f.select("path", "name"), type_bindings(found, own, center))
    holds = F.contains("content", F.lit(me[0]["name"].encode()))
    back = call_ops.callers(calls(found, holds).select("caller", "name"), f.where(F.col("path") == center).select("path", "name"))
    return call_ops.both(out, back)


def call_index(found: Index, buckets: int = 64) -> indexes.CallIndex:
    """All call edges, written so that one function's are read from a few files (``lookup_calls``)."""
    return indexes.build(calls(found).select("caller", "name", "site", "receiver"), functions(found).select("path", "name"), type_bindings(found), buckets)


def lookup_calls(found: Index, index: indexes.CallIndex, center: str) -> DataFrame:
    """The rows of ``resolve_calls`` from the index."""
    named = functions(found).where(F.col("path") == center).select("path", "name").collect()
    return indexes.lookup(index, {r["path"]: r["name"] for r in named})


def enclosing_functions(found: Index, places: DataFrame) -> DataFrame:
    """(file, id, at, function): the innermost function around each place (file, id, at) in a file's bytes."""
    f = functions(found).select("file", F.col("path").alias("id"), F.col("byte_start").alias("start"), F.col("byte_end").alias("end"))
    return intervals.innermost(places, f, "file").select("file", "id", "at", F.col("inner").alias("function"))


def roles(found: Index) -> DataFrame:
    """(path, role) of folders and files: what a name says, else what seven in ten files below
    say, else the nearest strong ancestor's."""
    files = found.nodes.where("kind = 'file'").select("path", "name", paths.file_role("name").alias("role"))
    named = found.nodes.where("kind = 'folder'").select("path", paths.folder_role("name").alias("named"))
    most = hierarchy.dominant_role(files).select(F.col("folder").alias("path"), F.when(F.col("strong"), F.col("role")).alias("most"))
    strong = named.join(most, "path", "left").select("path", F.coalesce("named", "most").alias("role")).where("role is not null").unionByName(files.where("role <> 'Source'").select("path", "role"))
    return hierarchy.nearest_strong(found.nodes.where("kind in ('folder', 'file')").select("path").distinct(), strong)


def layout(found: Index, cfg: pack.PackConfig = pack.PackConfig()) -> DataFrame:
    """(id, x, y, w, h) of every node; ids are kind, label, path and ordinal."""
    ident = F.concat_ws("|", "kind", F.coalesce("label", F.lit("")), "path", F.col("ordinal").cast("string"))
    n = found.nodes.withColumn("id", ident).join(roles(found), "path", "left").withColumn("role", paths.role_order(F.coalesce("role", F.lit("Source"))))
    n = saved(n.drop("order"))
    # an item's parent is the node of the parent path whose bytes hold it; a folder has no bytes
    holders = n.where("byte_start is not null").select(F.col("path").alias("key"), "id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"))
    inside = intervals.innermost(n.where("parent is not null and byte_start is not null").select(F.col("parent").alias("key"), "id", F.col("byte_start").alias("at")), holders)
    folders = n.where("byte_start is null").select(F.col("path").alias("parent"), F.col("id").alias("folder_id"))
    j = n.join(inside.select("id", "inner"), "id", "left").join(folders, "parent", "left")
    j = saved(j.withColumn("parent_id", F.coalesce("inner", "folder_id")).select(*n.columns, "parent_id"))
    chain = j.select("id", "parent_id", F.array().cast("array<string>").alias("anc"), F.col("parent_id").alias("at"))
    deepest = j.agg(F.max("depth")).first()[0]
    step = j.select(F.col("id").alias("at"), F.col("parent_id").alias("next"))
    for _ in range(deepest or 0):
        chain = chain.join(step, "at", "left").select("id", "parent_id", F.when(F.col("at").isNull(), F.col("anc")).otherwise(F.concat(F.array("at"), "anc")).alias("anc"), F.col("next").alias("at"))
    nodes = j.join(chain.select("id", "anc"), "id")
    return pack.pack(nodes.select("id", "parent_id", "kind", "label", "path", "name", "ordinal", "role", "byte_start", "measure", "depth", "anc"), cfg, deepest)
