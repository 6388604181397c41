"""Parser, call scanner and type resolver by language."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from codeatlas.parse import Item, braces, file_doc, make, python, utf8

PARSERS: dict[str, Callable[[bytes], list[Item]]] = {lang: (lambda s, lang=lang: braces.items(s, lang)) for lang in ("rust", "c", "cpp", "javascript", "typescript", "tsx", "csharp", "glsl", "hlsl")}
PARSERS |= {"python": python.items, "make": make.items}
#: Extensions (case counts) with a call graph, and their language.
CALL_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "csharp"}
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*\s*::\s*)*[A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>()]*>|<[\w\s,:&*]*>)?\s*\(")
_NOT_CALLED = braces._NOT_NAMES | frozenset("fn match loop let mut pub impl where struct enum trait as move async unsafe ref class".split())


@lru_cache(maxsize=2)  # the functions of one file come one after another
def _blanked(source: bytes, language: str) -> str:
    return braces.blank(source.decode("latin-1"), language)


def parse(source: bytes, language: str | None) -> list[Item]:
    return PARSERS[language](source) if language in PARSERS else []


def outline(source: bytes, language: str | None) -> list[Item]:
    """The items for callers that need no signatures and documentation; these may be missing."""
    return python.outline(source) if language == "python" else parse(source, language)


def doc(source: bytes, language: str | None) -> str | None:
    return python.file_doc(source) if language == "python" else file_doc(source.decode("latin-1")) if language == "rust" else None


def calls(source: bytes, ext: str, start: int, end: int) -> list[tuple[str, int, int, str | None]]:
    """Calls in a byte range: each name once, with its first site and that site's receiver."""
    language = CALL_LANGUAGES.get(ext)
    if language is None:
        return []
    if language == "python":
        found = python.calls(source, start, end)
    else:
        code, found = _blanked(source, language), []
        for m in _CALL.finditer(code, start, end):
            name = re.sub(r"\s", "", m[1])
            before = code[max(start, m.start() - 80) : m.start()]
            declared = re.search(r"(?:\bfn|\bfunction\s*\*?|\bclass|\bdef)\s*$", before)
            if name in _NOT_CALLED or declared or m.start() == start:
                continue
            if language in ("c", "cpp", "csharp") and re.search(r"[\w>*&]\s+$", before) and not re.search(r"\b(?:return|else|new|throw|await|case|in)\s+$", before):
                continue  # a declaration's name
            receiver = re.search(r"([A-Za-z_$][\w$]*)\s*(?:\?\.|->|\.)\s*$", before)
            if receiver and re.search(r"(?:\.|->|::)\s*$", before[: receiver.start()]):
                receiver = None
            found.append((utf8(name), m.start(), m.end(), receiver[1] if receiver else None))
    seen: set[str] = set()
    return [c for c in found if not (c[0] in seen or seen.add(c[0]))]


_TS_PARAM = re.compile(r"([A-Za-z_$][\w$]*)\??\s*:\s*([A-Za-z_$][\w$.]*)")
_TS_VAR = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::\s*([A-Za-z_$][\w$.]*)[^=;\n]*)?(?:=\s*(new\s+)?([A-Za-z_$][\w$]*)\s*(?:<[^<>]*>)?\s*\()?")


def bindings(source: bytes, ext: str, start: int, end: int, enclosing: str | None, classes: set[str], returns: dict[str, str]) -> dict[str, str]:
    """Variable to class in one function; the first binding wins."""
    if ext == "py":
        return python.bindings(source, start, enclosing, classes, returns)
    if ext not in ("ts", "tsx", "js", "jsx"):
        return {}
    code = _blanked(source, "typescript")[start:end]
    if re.match(r"(?:export\s+)?(?:const|let|var)\b", code):
        return {}  # begins before its function
    out: dict[str, str] = {"this": enclosing} if enclosing else {}
    body = code.find("{")
    for m in _TS_PARAM.finditer(code, 0, body if body >= 0 else len(code)):
        if code.rfind(")", 0, m.start()) < code.find("("):
            out.setdefault(m[1], m[2])
    for m in _TS_VAR.finditer(code, max(body, 0)):
        kind = m[2] or (m[4] if m[4] and (m[3] or m[4] in classes) else returns.get(m[4]) if m[4] else None)
        if kind:
            out.setdefault(m[1], kind)
    return out
