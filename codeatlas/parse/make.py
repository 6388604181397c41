"""Makefiles: a target for each rule, and sections that cover all other bytes."""

from __future__ import annotations

import re

from codeatlas.parse import Item, signature, utf8

_RULE = re.compile(r"^(?![\t #])(?!(?:export|define|endef|ifn?eq|ifn?def|else|endif|-?include|override)\b)([^\n:=#]+?)\s*::?(?![=:])[^\n]*(?:\n|\Z)(?:(?:\t[^\n]*|[ \t]*#[^\n]*|[ \t]*)(?:\n|\Z)(?=\t|[ \t]*\n\t)|\t[^\n]*(?:\n|\Z))*", re.M)


def _section(text: str, first: bool) -> str:
    for name, p in (("Definitions", r"^define\b"), ("Conditionals", r"^(?:ifn?eq|ifn?def|else|endif)\b"), ("Includes", r"^[-s]?include\b"), ("Variables", r"^(?:export\s+|override\s+)?[\w.$(){}-]+\s*(?:[:+?!]|::)?=")):
        if re.search(p, text, re.M):
            return name
    return "Preamble" if first else "Section"


def items(source: bytes) -> list[Item]:
    text = source.decode("latin-1")
    # rules inside a definition belong to it
    inside = [m.span() for m in re.finditer(r"^define\b.*?^endef\b[^\n]*", text, re.M | re.S)]
    out: list[Item] = []
    at = 0

    def gap(a: int, b: int) -> None:
        if b > a:
            out.append(Item("section", _section(text[a:b], not out), a, b, signature(text[a:b].split("\n")[0])))

    for m in _RULE.finditer(text):
        if m.start() < at or any(a <= m.start() < b for a, b in inside) or m[0] == "":
            continue
        gap(at, m.start())
        out.append(Item("target", utf8(" ".join(m[1].split())), m.start(), m.end(), signature(m[0].split("\n")[0])))
        at = m.end()
    gap(at, len(text))
    return out
