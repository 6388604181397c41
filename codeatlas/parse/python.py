"""Python by its own grammar; an indentation scanner where a file doesn't parse."""

from __future__ import annotations

import ast
import re

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

from codeatlas.parse import Item, doc_above, nest, signature


class _Offsets:
    def __init__(self, source: bytes):
        self.line = [0]
        for row in source.split(b"\n"):
            self.line.append(self.line[-1] + len(row) + 1)

    def __call__(self, row: int, col: int) -> int:
        return self.line[row - 1] + col


def clean_docstring(raw: str) -> str:
    """Without the least indent of later lines and blank ends."""
    rows = raw.expandtabs().split("\n")
    indent = min((len(r) - len(r.lstrip()) for r in rows[1:] if r.strip()), default=0)
    rows = [rows[0].strip(), *(r[indent:].rstrip() for r in rows[1:])]
    while rows and not rows[0].strip():
        rows.pop(0)
    while rows and not rows[-1].strip():
        rows.pop()
    return "\n".join(rows)


def _docstring(body: list[ast.stmt]) -> str | None:
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        return clean_docstring(body[0].value.value) or None
    return None


@lru_cache(maxsize=2)  # the functions of one file come one after another
def tree(source: bytes) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


_DEF = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_SIMPLE = (ast.Expr, ast.Assign, ast.Return, ast.AugAssign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.Pass, ast.Raise, ast.Assert, ast.Delete, ast.Global, ast.Nonlocal, ast.Break, ast.Continue)


def _statements(node: ast.AST) -> Iterator[ast.stmt]:
    """All statements below a node. They are never inside expressions, which are most of a tree."""
    todo = [node]
    while todo:
        node = todo.pop()
        for part in ("body", "orelse", "finalbody"):
            for s in getattr(node, part, ()):
                yield s
                if not isinstance(s, _SIMPLE):
                    todo.append(s)
        for part in ("handlers", "cases"):  # not statements themselves
            todo += getattr(node, part, ())


def items(source: bytes) -> list[Item]:
    module = tree(source)
    return _scan(source) if module is None else _from(ast.walk(module), source, True)


def outline(source: bytes) -> list[Item]:
    """The items without signatures and documentation (a file that doesn't parse may have them)."""
    module = tree(source)
    return _scan(source) if module is None else _from(_statements(module), source, False)


def _from(nodes: Iterable[ast.AST], source: bytes, texts: bool) -> list[Item]:
    at, text = _Offsets(source), source.decode("latin-1")
    found = []
    for node in nodes:
        if isinstance(node, _DEF):
            start = at(node.lineno, node.col_offset)
            outer = min([start, *(source.rfind(b"@", 0, at(d.lineno, d.col_offset)) for d in node.decorator_list)])
            end = at(node.end_lineno, node.end_col_offset)
            described = (signature(text[outer:end]), doc_above(text, outer) or _docstring(node.body)) if texts else ()
            found.append(Item("class" if isinstance(node, ast.ClassDef) else "fn", node.name, outer, end, *described))
    return nest(found)


def file_doc(source: bytes) -> str | None:
    module = tree(source)
    return _docstring(module.body) if module is not None else None


def _scan(source: bytes) -> list[Item]:
    """Definitions by their lines; each goes to the next line of no deeper indent."""
    text = source.decode("latin-1")
    found, rows = [], []
    for m in re.finditer(r"[^\n]*(?:\n|\Z)", text):
        if m[0].strip():
            rows.append((m.start(), m.end(), len(m[0]) - len(m[0].lstrip()), m[0]))
    for i, (start, end, indent, line) in enumerate(rows):
        if d := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line):
            for _, e, deep, _ in rows[i + 1 :]:
                if deep <= indent:
                    break
                end = e
            a, b = start + indent, start + len(text[start:end].rstrip())
            found.append(Item("class" if d[1] == "class" else "fn", d[2], a, b, signature(text[a:b]), doc_above(text, a)))
    return nest(found)


def calls(source: bytes, start: int, end: int) -> list[tuple[str, int, int, str | None]]:
    """(name, site start, site end, receiver) of the calls in a byte range, in source order."""
    module = tree(source)
    if module is None:
        return []
    at, found = _Offsets(source), []
    for node in ast.walk(module):
        if isinstance(node, ast.Call):
            f = node.func
            a, b = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            if a < start or b > end:
                continue
            if isinstance(f, ast.Name):
                found.append((f.id, a, b, None))
            elif isinstance(f, ast.Attribute):
                found.append((f.attr, a, b, f.value.id if isinstance(f.value, ast.Name) else None))
    return sorted(found, key=lambda c: (c[1], -c[2]))


@lru_cache(maxsize=2)
def _functions(source: bytes) -> list[tuple[int, int, ast.AST]]:
    """(start, end, node) of a file's functions by start, found in one walk for all of them."""
    module = tree(source)
    if module is None:
        return []
    at = _Offsets(source)
    found = [(at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset), n) for n in ast.walk(module) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return sorted(found, key=lambda f: f[0])


def _type_name(node: ast.expr | None) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Subscript):
        return _type_name(node.value)
    return None


def bindings(source: bytes, start: int, enclosing: str | None, classes: set[str], returns: dict[str, str]) -> dict[str, str]:
    """Variable to class in the function that begins at a byte: the first parameter is the
    enclosing class, then annotations, constructors and calls of known return type; the first
    binding of a variable wins. Empty where no function begins right there (a decorated one
    begins at its decorator)."""
    every = _functions(source)
    before = range(bisect_right(every, start, key=lambda f: f[0]) - 1, -1, -1)
    node = next((every[i][2] for i in before if start < every[i][1]), None)
    if node is None:
        return {}
    out: dict[str, str] = {}
    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    for i, a in enumerate(args):
        kind = enclosing if i == 0 and enclosing and enclosing in classes else _type_name(a.annotation)
        if i == 0 and enclosing and a.arg == "self":
            kind = enclosing
        if kind:
            out.setdefault(a.arg, kind)
    for s in sorted((n for n in _statements(node) if isinstance(n, (ast.Assign, ast.AnnAssign))), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(s, ast.AnnAssign):
            if isinstance(s.target, ast.Name) and (kind := _type_name(s.annotation)):
                out.setdefault(s.target.id, kind)
        elif len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name):
            kind = s.value.func.id if s.value.func.id in classes else returns.get(s.value.func.id)
            if kind:
                out.setdefault(s.targets[0].id, kind)
    return out
