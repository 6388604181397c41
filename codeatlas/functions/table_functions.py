"""Chunkers, parsers and type resolvers as table functions for SQL, with transfer by Arrow.

``register(spark)`` makes them known to a session:

- ``chunk_lines(TABLE(lines) PARTITION BY (key) ORDER BY (line_no), strategy, size)``: rows of lines as
  (key, line_no, text) to chunks; strategy ``headings`` or ``lines``. One line at a time, with a few
  numbers of state, so memory is bounded for any text (one text is one task's work;
  operators.sections spreads a text over tasks).
- ``parse_items(language, source)``: the items of one file, for LATERAL joins.
- ``type_bindings(ext, source)``: variable and class in each function of one file, likewise.
  Both are SQL functions over ``parse_items_lists`` and ``type_bindings_lists``, which give a file's rows as an array.

Callables of one's own join the languages by ``register(spark, parsers=..., resolvers=...)``.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udf, udtf

_HEADING = re.compile(r" {0,3}#{1,6}[ \t]")


def _label(line: str) -> str:
    return re.sub(r"^ *#*", "", line).strip()


class ChunkLines:
    """Null lines are neither heading nor blank; a table without rows has no chunks. An unknown
    strategy is an error."""

    def __init__(self) -> None:
        self.at: int | None = None

    def eval(self, row: Row, strategy: str, size: int) -> Iterator[tuple]:
        if strategy not in ("headings", "lines"):
            raise ValueError(f"no chunk strategy {strategy!r}: headings or lines")
        key, line, text = row[0], row[1], "-" if row[2] is None else row[2]
        head = strategy == "headings" and bool(_HEADING.match(text))
        if self.at is None:
            self.key, self.at, self.seen, self.label = key, line, head, _label(text) if head else None
        else:
            due = line - self.at >= size
            new = due if strategy == "lines" else (self.seen if head else due and not text.strip())
            if new:
                yield self._chunk(line)
                self.at, self.label = line, _label(text) if head else None
            self.seen |= head
        self.end = line + 1

    def _chunk(self, end: int) -> tuple:
        return str(self.key) if self.key is not None else None, self.at, end, self.label if self.label is not None else f"{self.at + 1}\u2013{end}"

    def terminate(self) -> Iterator[tuple]:
        if self.at is not None:
            yield self._chunk(self.end)


def _items(parse: Callable) -> Callable:
    """Rows of the items of one source, in source order; a null source or an unknown language has none."""

    def of(language: str | None, source: str | None) -> Iterator[tuple]:
        from codeatlas.parse import rows

        data = (source or "").encode()
        todo = [(i, 1) for i in reversed(parse(data, language))]
        n = 0
        while todo:
            i, depth = todo.pop()
            yield n, i.label, i.name, rows(data, i.start, i.end), depth
            n += 1
            todo += [(c, depth + 1) for c in reversed(i.children)]

    return of


def _bindings(parse: Callable, resolve: Callable, languages: dict[str, str]) -> Callable:
    """Rows of the variables of known class in each function of one source, by name; none for an unknown
    extension. Classes are those of the file; what a call returns is not followed."""

    def of(ext: str | None, source: str | None) -> Iterator[tuple]:
        data = (source or "").encode()
        todo = [(i, None) for i in reversed(parse(data, languages.get(ext)))]
        every, functions = [], []
        while todo:
            i, around = todo.pop()
            every.append(i)
            if i.label == "fn":
                functions.append((i, around))
            todo += [(c, i.name if i.label == "class" else around) for c in reversed(i.children)]
        classes = {i.name for i in every if i.label == "class"}
        for i, around in functions:
            for name, kind in sorted(resolve(data, ext, i.start, i.end, around, classes, {}).items()):
                yield i.name, name, kind

    return of


def _lists(of: Callable, columns: dict[str, str]):
    """The rows of each source as a list, for a whole Arrow batch of sources at once: a table function in
    Python sends the few rows of each source as a batch of their own, which costs more than parsing it."""

    @arrow_udf(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in columns.items())}>>")
    def lists(kind: pa.Array, source: pa.Array) -> pa.Array:
        ends, found = [0], []
        collects = gc.isenabled()
        gc.disable()  # syntax trees have no cycles; looking for them takes an eighth of the time
        try:
            for k, s in zip(kind, source):
                found += of(k.as_py(), s.as_py())
                ends.append(len(found))
        finally:
            if collects:
                gc.enable()
        arrays = [pa.array(v, getattr(pa, "int32" if kind == "int" else kind)()) for v, kind in zip(zip(*found) if found else [[]] * len(columns), columns.values())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, list(columns)))

    return lists


def register(spark: SparkSession, parsers: dict[str, Callable] | None = None, resolvers: dict[str, Callable] | None = None) -> None:
    """Registers the three functions. ``parsers``: further languages as f(source bytes) -> items;
    ``resolvers``: further extensions as f(source, ext, start, end, enclosing, classes, returns) ->
    {variable: class}, each parsed as the language of its extension, or of the same name."""
    from codeatlas.parse import registry

    more, own = dict(parsers or {}), dict(resolvers or {})
    languages = {**registry.CALL_LANGUAGES, **{x: x for x in own if x not in registry.CALL_LANGUAGES}}
    parse = lambda source, language: more[language](source) if language in more else registry.outline(source, language)
    resolve = lambda source, ext, *rest: (own[ext] if ext in own else registry.bindings)(source, ext, *rest)
    spark.udtf.register("chunk_lines", udtf(ChunkLines, returnType="key string, start_line long, end_line long, label string", useArrow=True))
    for name, argument, of, columns in (
        ("parse_items", "language", _items(parse), {"n": "int", "label": "string", "name": "string", "lines": "int", "depth": "int"}),
        ("type_bindings", "ext", _bindings(parse, resolve, languages), {"function": "string", "variable": "string", "class": "string"}),
    ):
        spark.udf.register(f"{name}_lists", _lists(of, columns))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} STRING, source STRING) RETURNS TABLE ({', '.join(f'{c} {t}' for c, t in columns.items())}) RETURN SELECT inline({name}_lists({argument}, source))")
