"""Paths, names and what they say: languages, categories, roles. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeatlas.functions import tables as t
from codeatlas.functions.text import _col

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: str | Column) -> Column:
    return F.translate(_col(c), _UP, _LOW)


def file_part(path: str | Column) -> Column:
    """The file of a qualified path: before ``::``, then before ``#``."""
    return F.substring_index(F.substring_index(_col(path), "::", 1), "#", 1)


def file_name(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: str | Column) -> Column:
    """After the last dot of the file name; null without one or for a name that only begins with a dot."""
    name = file_name(file_part(path))
    return F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1), F.lit(""))


def join_path(parent: str | Column, name: str | Column) -> Column:
    return F.concat_ws("/", F.nullif(_col(parent), F.lit("")), _col(name))


def normalise_path(path: str | Column) -> Column:
    """Backslashes to slashes, without leading ``./`` and ``/``."""
    return F.regexp_replace(F.translate(_col(path), "\\", "/"), r"^(\./|/)+", "")


def folder_prefixes(path: str | Column) -> Column:
    """The folders above a path, without the root."""
    p = F.split(_col(path), "/")
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def language(path: str | Column) -> Column:
    ext = F.lower(extension(path))
    out = F.when(file_name(path).isin(t.MAKE_NAMES), "make")
    for name, exts in t.LANGUAGES.items():
        out = out.when(ext.isin(exts.split()), name)
    return out


def category(ext: str | Column) -> Column:
    out = None
    for name, (_, _, exts) in t.CATEGORIES.items():
        if exts:
            hit = _col(ext).isin(exts.split())
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def category_order(name: str | Column) -> Column:
    return F.create_map(*(F.lit(x) for k, (o, _, _) in t.CATEGORIES.items() for x in (k, o)))[_col(name)]


def category_default(name: str | Column) -> Column:
    return _col(name).isin([k for k, (_, on, _) in t.CATEGORIES.items() if on])


def is_retained_text(ext: str | Column) -> Column:
    return F.coalesce(_col(ext).isin(t.RETAINED_TEXT), F.lit(False))


def name_tokens(name: str | Column) -> Column:
    """ASCII-lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(ascii_lower(name), r"[^a-z0-9]+"), lambda x: x != "")


def collapsed(name: str | Column) -> Column:
    return F.regexp_replace(ascii_lower(name), r"[^a-z0-9]+", "")


def _signal(name: Column, words: str) -> Column:
    w = words.split()
    return F.arrays_overlap(name_tokens(name), F.array(*map(F.lit, w))) | collapsed(name).isin(w)


def folder_role(name: str | Column) -> Column:
    """The role that a folder's name says, or null."""
    out = None
    for role in t.ROLE_PRECEDENCE:
        hit = _signal(_col(name), t.FOLDER_SIGNALS[role])
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out


def file_role(name: str | Column) -> Column:
    """The role of a file by its stem's words and its extension; Source where nothing says more."""
    n = _col(name)
    dotted = n.contains(".")
    stem = F.when(dotted, F.regexp_extract(n, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(n)
    ext = F.when(dotted, ascii_lower(F.substring_index(n, ".", -1)))
    out = F.when(_signal(stem, t.FILE_SIGNALS["Generated"]), "Generated").when(_signal(stem, t.FILE_SIGNALS["Test"]), "Test").when(_signal(stem, t.FILE_SIGNALS["Example"]), "Example")
    return out.when(ext.isin(t.ASSET_EXTENSIONS), "ShaderAsset").when(ext.isin(t.DOC_EXTENSIONS), "Docs").otherwise("Source")


def role_order(role: str | Column) -> Column:
    return F.create_map(*(F.lit(x) for i, k in enumerate(t.ROLES) for x in (k, i)))[_col(role)]


def kind_rank(kind: str | Column, label: str | Column) -> Column:
    """Packing group of a sibling: types, functions, classes, modules, other items."""
    lab = _col(label)
    item = F.when(lab.isin("struct", "enum", "trait", "interface", "type"), 0).when(lab == "fn", 1).when(lab.isin("class", "impl"), 2).when(lab.isin("module", "namespace"), 3).otherwise(4)
    return F.when(_col(kind) == "item", item).otherwise(0)


def is_source_ordered(path: str | Column) -> Column:
    return F.coalesce(extension(path).isin(t.SOURCE_ORDERED), F.lit(False))


def parent_name(path: str | Column) -> Column:
    """The parts between file and leaf, joined by ``::``."""
    p = F.split(_col(path), "::")
    return F.when(F.size(p) > 2, F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), "::")).otherwise("")


def enclosing_class(path: str | Column) -> Column:
    """The second-to-last part where there are three or more."""
    p = F.split(_col(path), "::")
    return F.when(F.size(p) >= 3, F.get(p, F.size(p) - 2))


def fuzzy_match(query: str, name: str | Column) -> Column:
    """The query's characters occur in the name in order, in any case; an empty one matches all."""
    pattern = "(?s)" + ".*".join(r"\Q" + c + r"\E" for c in query.lower())
    return F.lower(_col(name)).rlike(pattern) if query else F.lit(True)


def in_folder(path: str | Column, folder: str, root_name: str | None = None) -> Column:
    """A filter without a slash meets any component; with one it is a prefix of components, tried
    again without the root folder's own name in front."""
    parts = F.split(_col(path), "/")
    f = folder.strip("/")
    if "/" not in f:
        return F.array_contains(parts, f)
    want = f.split("/")
    hit = F.slice(parts, 1, len(want)) == F.array(*map(F.lit, want))
    if root_name and want[0] == root_name and len(want) > 1:
        hit = hit | (F.slice(parts, 1, len(want) - 1) == F.array(*map(F.lit, want[1:])))
    return hit
