"""Highlighted text: kinds of captures, spans of each line, and runs of one colour."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.tables import CAPTURES, WHOLE_CAPTURES
from codeatlas.operators import spans

KINDS = [*CAPTURES, "Default"]


def kind_of(capture: str | Column) -> Column:
    """The kind of a capture: by its whole name, else by the part before the first dot; null where
    neither says one."""
    c = F.col(capture) if isinstance(capture, str) else capture
    head = F.substring_index(c, ".", 1)
    out = None
    for name, kind in WHOLE_CAPTURES.items():
        out = F.when(c == name, kind) if out is None else out.when(c == name, kind)
    for kind, names in CAPTURES.items():
        out = out.when(head.isin(names.split()), kind)
    return out


def line_spans(captures: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, spans) of captures (key, start, end, capture): each is clipped to the lines
    that it meets; in a line, of overlapping ones the outer stays. Lines without spans have no row."""
    kinds = captures.select(key, "start", "end", kind_of("capture").alias("kind")).where("kind is not null and start < end")
    # the whole capture goes along: of two that are alike in a line, the one that begins sooner or goes on longer is the outer
    met = spans.by_line(kinds.withColumn("kind", F.struct("start", (-F.col("end")).alias("back"), "kind")), lines, key).where("s < e")
    some = met.groupBy(key, "line_no").agg(F.array_sort(F.collect_list(F.struct(F.col("kind.start").alias("o"), F.col("kind.back").alias("back"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("kind.kind").alias("kind")))).alias("spans"))
    some = some.withColumn("spans", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return some.select(key, "line_no", spans.without_overlap(F.col("spans")).alias("spans"))


def runs(length: Column, found: Column) -> Column:
    """(length, kind) of neighbouring runs that cover a line: its spans (disjoint, in order), and
    Default between them and up to the end."""
    size = length.cast("long")
    none = F.struct(F.array().cast("array<struct<n:bigint,kind:string>>").alias("runs"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        a, b = F.least(s["start"].cast("long"), size), F.least(s["end"].cast("long"), size)
        gap = F.struct((a - acc["at"]).alias("n"), F.lit("Default").alias("kind"))
        own = F.struct((b - a).alias("n"), s["kind"].alias("kind"))
        more = F.filter(F.array(gap, own), lambda r: r["n"] > 0)
        return F.struct(F.concat(acc["runs"], more).alias("runs"), F.greatest(acc["at"], b).alias("at"))

    end = lambda acc: F.concat(acc["runs"], F.filter(F.array(F.struct((size - acc["at"]).alias("n"), F.lit("Default").alias("kind"))), lambda r: r["n"] > 0))
    return F.aggregate(found, none, step, end)


# -- captures of source files ---------------------------------------------------------------

_WORDS = {
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while",
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "async await break case catch class const continue default delete do else export extends finally for function if import in instanceof let new of return static switch throw try typeof var void while yield",
    "c": "break case const continue default do else enum extern for goto if inline return sizeof static struct switch typedef union volatile while",
    "make": "define else endef endif ifdef ifeq ifndef ifneq include override export",
}
_WORDS["typescript"] = _WORDS["tsx"] = _WORDS["javascript"] + " abstract declare enum implements interface keyof namespace private protected public readonly type"
_WORDS["cpp"] = _WORDS["c"] + " catch class constexpr delete explicit friend mutable namespace new noexcept operator override private protected public template this throw try typename using virtual"
_WORDS["csharp"] = _WORDS["cpp"] + " abstract async await base foreach in interface internal is lock out params partial readonly record ref sealed var"
_WORDS["glsl"] = _WORDS["c"] + " attribute buffer in inout layout out precision uniform varying"
_WORDS["hlsl"] = _WORDS["c"] + " cbuffer in inout out register"
_WORDS["toml"] = "true false"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_TEXT = {"rust": r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\])'", "python": r"(?i:[rbuf]{0,2})(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|" + _QUOTED + ")", "javascript": _QUOTED + r"|`(?:\\[\s\S]|[^`\\])*`"}
_TEXT["typescript"] = _TEXT["tsx"] = _TEXT["javascript"]
_REMARK = {k: r"#[^\n]*" for k in ("python", "make", "toml")}
_MARKDOWN = re.compile(r"(?P<title>^ {0,3}#{1,6}[ \t][^\n]*)|(?P<literal>^```[\s\S]*?^```[^\n]*|`[^`\n]+`)|\[[^\]\n]*\]\((?P<uri>[^)\n]+)\)", re.M)


def _pattern(language: str) -> re.Pattern:
    remark = _REMARK.get(language, r"//[^\n]*|/\*[\s\S]*?\*/")
    return re.compile(rf"(?P<comment>{remark})|(?P<string>{_TEXT.get(language, _QUOTED)})|(?P<number>(?<![\w.])\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)(?P<call>\s*\()?(?P<key>\s*=(?!=))?")


_compiled: dict[str, re.Pattern] = {}
BATCH = 10_000  # captures a frame


def captures(text: str, language: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, capture) in bytes of one file's text, found by a scanner: comments, strings,
    numbers, keywords, called and declared names, types by their capital. No language: none."""
    if language == "markdown":
        found = ((m.start(g), m.end(g), f"text.{g}") for m in _MARKDOWN.finditer(text) for g in ("title", "literal", "uri") if m[g] is not None)
    elif language in _WORDS:
        found = _code(text, language)
    else:
        return
    if text.isascii():
        yield from found
        return
    at, size = 0, 0
    for a, b, name in found:  # in order, so each character is encoded once
        size += len(text[at:a].encode())
        n = len(text[a:b].encode())
        yield size, size + n, name
        at, size = b, size + n


def _code(text: str, language: str) -> Iterator[tuple[int, int, str]]:
    pattern = _compiled.get(language) or _compiled.setdefault(language, _pattern(language))
    known = frozenset(_WORDS[language].split())
    for m in pattern.finditer(text):
        if m.lastgroup in ("comment", "string", "number") or m["word"] is None:
            kind = next(g for g in ("comment", "string", "number") if m[g] is not None)
            yield m.start(kind), m.end(kind), kind
        elif m["word"] in known:
            yield m.start("word"), m.end("word"), "number" if language == "toml" else "keyword"
        elif m["call"]:
            yield m.start("word"), m.end("word"), "function"
        elif m["word"][0].isupper() and language not in ("make", "toml"):
            yield m.start("word"), m.end("word"), "type"
        elif m["key"] and language in ("toml", "make"):
            yield m.start("word"), m.end("word"), "property"


def file_captures(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, start, end, capture) of files (key, text, language). One pass over the texts."""

    columns = [key, "start", "end", "capture"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in it:
            rows: list[tuple] = []
            for k, text, language in d.itertuples(index=False):
                rows += [(k, a, b, c) for a, b, c in captures(text or "", language)]
                if len(rows) >= BATCH:  # many small files a frame, and never much more than one large file's
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "text", "language").mapInPandas(run, f"{key} {kind}, start long, end long, capture string")
