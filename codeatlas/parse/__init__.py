"""Symbols, calls and type bindings of source files: plain functions over the bytes of one file.

Python uses its own grammar. Other languages use a scanner that blanks comments and strings,
pairs braces and finds declarations by pattern; ranges that contain each other make the tree.
Offsets are bytes: sources are read as Latin-1, one character a byte.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Item:
    label: str
    name: str
    start: int
    end: int
    signature: str = ""
    doc: str | None = None
    children: list[Item] = field(default_factory=list)


def nest(items: list[Item]) -> list[Item]:
    """A forest by containment of byte ranges, in source order."""
    roots: list[Item] = []
    open_: list[Item] = []
    for it in sorted(items, key=lambda i: (i.start, -i.end)):
        while open_ and open_[-1].end < it.end:
            open_.pop()
        while open_ and not (open_[-1].start <= it.start and it.end <= open_[-1].end):
            open_.pop()
        (open_[-1].children if open_ else roots).append(it)
        open_.append(it)
    return roots


def utf8(s: str) -> str:
    """Text of Latin-1 characters that stand for UTF-8 bytes."""
    return s.encode("latin-1").decode("utf-8", "replace")


def rows(source: bytes, start: int, end: int) -> int:
    """Lines that a range touches."""
    return source.count(b"\n", start, max(start, end - 1)) + 1


def signature(text: str) -> str:
    cut = min((i for i in (text.find("{"), text.find(";")) if i >= 0), default=len(text))
    return " ".join(utf8(text[:cut]).split())


def doc_above(text: str, start: int) -> str | None:
    """The ``///`` lines right above, over blank and attribute lines; ``////`` ends them."""
    found: list[str] = []
    end = text.rfind("\n", 0, start)
    while end >= 0:
        begin = text.rfind("\n", 0, end)
        s, end = text[begin + 1 : end].strip(), begin
        if s.startswith("///") and not s.startswith("////"):
            found.append(utf8(s[3:].removeprefix(" ")))
        elif found or not (s == "" or s.startswith("#[")):
            break
    return "\n".join(reversed(found)) or None


def file_doc(text: str) -> str | None:
    """The leading ``//!`` lines."""
    out: list[str] = []
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("//!"):
            out.append(utf8(s[3:].removeprefix(" ")))
        elif out or s:
            break
    return "\n".join(out) or None
