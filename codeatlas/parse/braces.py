"""Declarations of the brace languages."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import lru_cache

from codeatlas.parse import Item, doc_above, nest, signature, utf8

_NOT_NAMES = frozenset("if for while switch return catch sizeof else do new delete throw using lock foreach fixed when defined case function await typeof in of super assert static_assert register packoffset layout".split())
#: words of field values; right inside a class body any other word can name a method
_NOT_METHODS = frozenset("if for while switch catch function".split())
_IDENT = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"


_NOISE = {
    "rust": re.compile(r"//|/\*|(?<!\w)b?r#*\"|\"|'"),
    "script": re.compile(r"//|/\*|['\"`/{}]"),
    "c": re.compile(r"//|/\*|(?<!\w)(?:u8|[uUL])?R\"|\"|'"),
    "csharp": re.compile(r"//|/\*|[$@]*\"|'"),
}
_FAMILY = {"rust": "rust", "javascript": "script", "typescript": "script", "tsx": "script", "csharp": "csharp"}
_COMMENT_ENDS = re.compile(r"/\*|\*/")
_QUOTED = {q: re.compile(rf"(?:\\.|[^{q}\\])*(?:{q}|\Z)", re.S) for q in "'\""}
_QUOTED_LINE = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "'\""}
_RUST_CHAR = re.compile(r"(?:\\(?:u\{[^}']*\}|x..|.)|[^'\\\n\x80-\xff]|[\x80-\xff]{2,4})'", re.S)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/>])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_VALUE = re.compile(r"(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await|instanceof|extends)$")


def _last(text: str, at: int) -> int:
    """Where the last character before a position is that isn't white space; -1 if none."""
    at -= 1
    while at >= 0 and text[at].isspace():
        at -= 1
    return at


def _value_follows(text: str, at: int) -> bool:
    """Whether a value, not an operator or a statement, begins at a position of a script."""
    i = _last(text, at)
    return i >= 0 and (text[i] in "=(,[:?&|!~+-*%^>" or _BEFORE_VALUE.search(text, max(0, i - 11), i + 1) is not None)


def _noise(text: str, family: str) -> list[tuple[int, int]]:
    """Ranges of comments, strings, characters and regular expressions. What a template string
    holds in ``${}`` is code; its marks are noise."""
    found, i, size = [], 0, len(text)
    inside: list[int] = []  # for each template that is open: braces open in its code

    def template(a: int, b: int) -> int:
        end = _TEMPLATE.match(text, b).end()
        if text.startswith("${", end):
            inside.append(0)
        end = min(size, end + (2 if text.startswith("${", end) else 1))
        found.append((a, end))
        return end

    while m := _NOISE[family].search(text, i):
        a, i, mark = m.start(), m.end(), m[0]
        if mark == "//":
            i = text.find("\n", i)
            while family == "c" and i > 0 and text[i - 1] == "\\":
                i = text.find("\n", i + 1)
            i = size if i < 0 else i
        elif mark == "/*":
            depth = 1
            while depth and (e := _COMMENT_ENDS.search(text, i)):
                depth += -1 if e[0] == "*/" else family == "rust"
                i = e.end()
            i = size if depth else i
        elif mark == "`":
            i = template(a, i)
            continue
        elif mark in "{}":
            if inside and mark == "}" and not inside[-1]:
                inside.pop()
                i = template(a, i)
            elif inside:
                inside[-1] += 1 if mark == "{" else -1
            continue
        elif mark == "/":
            e = _REGEX.match(text, a)
            before = _last(text, a)
            if not e or not (before < 0 or text[before] in "{;" or _value_follows(text, a)):
                continue
            i = e.end()
        elif family == "rust" and "r" in mark:
            e = text.find('"' + "#" * mark.count("#"), i)
            i = size if e < 0 else e + 1 + mark.count("#")
        elif mark.endswith('R"'):
            e = re.compile(r"([^\s()\\]*)\(").match(text, i)
            end = text.find(")" + e[1] + '"', e.end()) if e else -1
            i = end + len(e[1]) + 2 if end >= 0 else i
        elif family == "csharp" and "@" not in mark and mark.endswith('"') and text.startswith('""', i):
            quotes = re.compile('"+').match(text, i - 1)[0]
            e = text.find(quotes, i - 1 + len(quotes))
            i = size if e < 0 else e + len(quotes)
        elif "@" in mark:
            i = re.compile(r'(?:[^"]|"")*(?:"|\Z)').match(text, i).end()
        else:
            if mark == "'" and family == "c" and a and text[a - 1] in "0123456789abcdefABCDEF":
                continue  # between digits
            e = _RUST_CHAR.match(text, i) if family == "rust" and mark == "'" else (_QUOTED if family == "rust" else _QUOTED_LINE)[mark[-1]].match(text, i)
            if not e:
                continue
            i = e.end()
        found.append((a, i))
    return found


def blank(text: str, language: str) -> str:
    """Comments, strings and (for C) directives as spaces; line ends stay."""
    gone = lambda s: re.sub(r"[^\n]", " ", s)
    out, at = [], 0
    for a, b in _noise(text, _FAMILY.get(language, "c")):
        out += [text[at:a], gone(text[a:b])]
        at = b
    code = "".join([*out, text[at:]])
    if language in ("c", "cpp", "glsl", "hlsl", "csharp"):
        code = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: gone(m[0]), code, flags=re.M)
    return code


_OPENS = {")": "(", "]": "[", "}": "{"}


def partners(text: str) -> dict[int, int]:
    """Closing bracket of each opening one; the end of the text where none is left. A brace
    closes what is open within it."""
    found, open_, braces = {}, [], 0
    for m in re.finditer(r"[(){}\[\]]", text):
        if m[0] not in _OPENS:
            open_.append(m.start())
            braces += m[0] == "{"
            continue
        if m[0] == "}" and braces:
            braces -= 1
            while text[open_[-1]] != "{":
                found[open_.pop()] = m.start()
        if open_ and text[open_[-1]] == _OPENS[m[0]]:
            found[open_.pop()] = m.start()
    return found | dict.fromkeys(open_, len(text) - 1)


def around(pairs: dict[int, int], places: list[int]) -> list[int]:
    """The innermost open bracket around each of the ascending places; -1 if none."""
    out, open_, opens, n = [], [], sorted(pairs), 0
    for p in places:
        while n < len(opens) and opens[n] < p:
            while open_ and pairs[open_[-1]] < opens[n]:
                open_.pop()
            open_.append(opens[n])
            n += 1
        while open_ and pairs[open_[-1]] < p:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
    return out


def _head(text: str, at: int, extra: str = "") -> int:
    """Where the statement that holds a position begins."""
    i = max((text.rfind(c, 0, at) for c in ";{}" + extra), default=-1) + 1
    while i < at and text[i].isspace():
        i += 1
    return i


_MOD = r"(?:pub(?:\([^)]*\))?\s+|unsafe\s+|async\s+|const\s+|default\s+|extern(?:\s+\"[^\"]*\")?\s+)*"
_RUST = {"module": rf"{_MOD}mod\s+({_IDENT})", "struct": rf"{_MOD}struct\s+({_IDENT})", "enum": rf"{_MOD}enum\s+({_IDENT})", "trait": rf"{_MOD}trait\s+({_IDENT})", "impl": rf"{_MOD}impl\b([^{{;]*)", "fn": rf"{_MOD}fn\s+({_IDENT})"}
_CS_MOD = r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|unsafe|file|new|ref)\s+)*"
_TYPES = {
    "c": {"struct": rf"\bstruct(?:\s+({_IDENT}))?\s*(?=\{{)", "enum": rf"\benum(?:\s+({_IDENT}))?\s*(?=\{{)"},
    "cpp": {"struct": rf"\bstruct\b(?:\s+(?:alignas\s*\([^)]*\)\s*)?({_IDENT})[^;{{}}()]*+)?\s*+(?=\{{)", "enum": rf"\benum\b(?:\s+(?:class\s+|struct\s+)?({_IDENT})[^;{{}}()]*+)?\s*+(?=\{{)", "class": rf"(?<!enum )\bclass\b(?:\s+({_IDENT})[^;{{}}()]*+)?\s*+(?=\{{)", "namespace": rf"\bnamespace(?:\s+([\w:]+))?\s*(?=\{{)"},
    "csharp": {"class": rf"{_CS_MOD}(?:class|record(?:\s+class|\s+struct)?)\s+({_IDENT})", "interface": rf"{_CS_MOD}interface\s+({_IDENT})", "struct": rf"{_CS_MOD}(?<!record )struct\s+({_IDENT})", "enum": rf"{_CS_MOD}enum\s+({_IDENT})", "namespace": r"namespace\s+([\w.]+)"},
    "glsl": {"struct": rf"\bstruct\s+({_IDENT})\s*(?=\{{)", "interface": rf"(?:uniform|buffer|in|out)\s+({_IDENT})\s*(?=\{{)"},
    "hlsl": {"struct": rf"\bstruct\s+({_IDENT})\s*(?=\{{)", "cbuffer": rf"\bcbuffer\s+({_IDENT})[^;{{}}]*(?=\{{)"},
}
_SCRIPT = {"fn": rf"(?:async\s+)?function\s*\*?\s*({_IDENT})\s*(?:<[^(){{}}]*>)?\s*(?=\()", "class": rf"class\s+({_IDENT})"}
_TYPED = {"interface": rf"interface\s+({_IDENT})", "enum": rf"(?:const\s+)?enum\s+({_IDENT})", "type": rf"type\s+({_IDENT})\s*(?:<[^=]*>)?\s*="}
_CLASS = re.compile(r"(?<![\w$.])class(?![\w$])")
_FUNCTION = re.compile(rf"((?:{_IDENT}\s*(?:<[^<>;{{}}]*>)?\s*::\s*)*(?:~?{_IDENT}|operator\s*[^\s\w(]+(?:\(\))?))\s*(?:<[^<>;{{}}()]*>)?\s*\(([^;{{}}]*)\)([^;{{}}()=]*(?:\([^(){{}};]*\)[^;{{}}()=]*)*)\{{")
_UNBODIED = re.compile(rf"(?<![\w$~])((?:{_IDENT}\s*(?:<[^<>;{{}}]*>)?\s*::\s*)*(?:~\s*{_IDENT}|{_IDENT}|operator\s*(?:\(\)|[^\s\w(]+)))\s*(?=\()")
_MEMBER = re.compile(rf"(?<![\w$.])({_IDENT})\s*(?:<[^<>;{{}}()]*>)?\s*(?=\()")
_ARROW = re.compile(rf"(?<![\w$.])(?:const|let|var)\s+({_IDENT})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^(){{}}=]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{}}]+)?|{_IDENT})\s*=>")
_METHOD = re.compile(rf"(?<![\w$.#])(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+(?!\())*(?:\*\s*)?(#?{_IDENT}|\[[^\[\]{{}}]*\])\s*(?:<[^<>(){{}}]*>)?\s*\(")


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(r"(?<![\w$])" + pattern if not pattern.startswith((r"\b", "(?<")) else pattern)


def _body(code: str, pairs: dict[int, int], at: int, script: bool = False) -> int | None:
    """Where the brace or semicolon is that ends a header, past the brackets and (in scripts) the
    types in braces that it holds."""
    stops, angles = re.compile(r"[(){}\[\];]"), 0
    while m := stops.search(code, at):
        i = m.start()
        angles += code.count("<", at, i) - code.count(">", at, i) + code.count("=>", at, i)
        if m[0] in "([" or m[0] == "{" and script and (angles > 0 or (before := _last(code, i)) >= 0 and code[before] in ":|&<,"):
            at = pairs[i] + 1
        else:
            return i if m[0] in "{;" else None
    return None


def _close(code: str, pairs: dict[int, int], at: int, needs_body: bool = False, script: bool = False) -> int | None:
    """The end of a declaration whose header is at a position: its braces or its semicolon."""
    i = _body(code, pairs, at, script)
    if i is None or code[i] == ";" and needs_body:
        return None
    return pairs[i] + 1 if code[i] == "{" else i + 1


_GOES_ON = re.compile(r"\s*(?:[.?:&|+*/%<>=,)\]]|-|in\b|of\b|instanceof\b|as\b)")


def _value_end(code: str, pairs: dict[int, int], at: int) -> int:
    """The end of a value: before a semicolon, a comma or a closing bracket, or at the end of a
    line where the next one doesn't go on with it."""
    stops, began = re.compile(r"[(){}\[\];,\n]"), at
    while m := stops.search(code, at):
        i = m.start()
        if m[0] in "([{":
            at = pairs[i] + 1
        elif m[0] != "\n":
            return i
        else:
            before = _last(code, i)
            if before >= began and code[before] not in "=(,[:?&|!~+-*%^<>." and not _GOES_ON.match(code, i):
                return i
            at = i + 1
    return len(code)


def _impl_name(text: str) -> str:
    t = " ".join(text.split())
    if t.startswith("<"):
        depth = 0
        for i, c in enumerate(t):
            depth += (c == "<") - (c == ">" and t[i - 1] != "-")
            if depth == 0:
                t = t[i + 1 :].strip()
                break
    return utf8(re.sub(r"\s+where\b.*$", "", t))


def items(source: bytes, language: str) -> list[Item]:
    text = source.decode("latin-1")
    code = blank(text, language)
    pairs = partners(code)
    found: list[Item] = []

    def add(label: str, name: str, start: int, end: int | None) -> None:
        if end is not None and name:
            found.append(Item(label, utf8(name), start, end, signature(text[start:end]), doc_above(text, start)))

    if language == "rust":
        for label, p in _RUST.items():
            for m in _compiled(p).finditer(code):
                name = _impl_name(m[1]) if label == "impl" else m[1]
                # `impl Trait` inside a signature or type isn't an item
                if label == "impl" and _head(code, m.start(), ")") != m.start() and not code[_head(code, m.start()) : m.start()].strip().endswith("]"):
                    continue
                add(label, name, m.start(), _close(code, pairs, m.end() if label != "impl" else m.end(1), label in ("fn", "trait", "impl", "enum")))
    elif language in ("javascript", "typescript", "tsx"):
        specs = _SCRIPT | (_TYPED if language != "javascript" else {})
        for label, p in specs.items():
            for m in _compiled(p).finditer(code):
                if label in ("fn", "class") and _value_follows(code, m.start()) or label == "class" and re.search(r"(?<![\w$])abstract\s+$", code[max(0, m.start() - 20) : m.start()]):
                    continue  # a value, or a kind of its own
                if label == "type":
                    end = _value_end(code, pairs, m.end())
                    add(label, m[1], m.start(), end + (end < len(code) and code[end] == ";"))
                else:
                    add(label, m[1], m.start(), _close(code, pairs, m.end(), True, True))
        for m in _ARROW.finditer(code):
            rest = re.compile(r"\s*").match(code, m.end()).end()
            end = pairs[rest] + 1 if rest < len(code) and code[rest] == "{" else rest
            end = _value_end(code, pairs, end)  # with what else is declared
            while end < len(code) and code[end] == ",":
                end = _value_end(code, pairs, end + 1)
            add("fn", m[1], m.start(), end + (end < len(code) and code[end] == ";"))
        classes = {_body(code, pairs, m.end(), True) for m in _CLASS.finditer(code)}
        methods = list(_METHOD.finditer(code))
        for m, brace in zip(methods, around(pairs, [m.start(1) for m in methods]), strict=True):
            before = code[_last(code, m.start())] if _last(code, m.start()) >= 0 else ""
            if brace < 0 or code[brace] != "{" or m[1] in _NOT_METHODS:
                continue
            if brace in classes:
                held = before not in "=(,.?:&|+-*/<>!["
            else:  # in an object; what follows a label of a switch is a block
                held = before in "{," and _value_follows(code, brace) and not re.search(r"(?<![\w$])(?:case\b[^:\n]*|default\s*):\s*$|=>\s*$", code[max(0, brace - 200) : brace])
            after = pairs[m.end() - 1] + 1
            if held and (follows := re.compile(r"\s*[{:]").match(code, after)):
                end = pairs[follows.end() - 1] + 1 if follows[0][-1] == "{" else _close(code, pairs, after, True, True)
                add("fn", m[1], m.start(), end)
    else:
        for label, p in _TYPES[language].items():
            for m in _compiled(p).finditer(code):
                start = _head(code, m.start()) if label == "interface" and language == "glsl" else m.start() + len(m[0]) - len(m[0].lstrip())
                if language == "cpp" and label == "struct" and re.search(r"\benum\s+$", code[max(0, start - 20) : start]):
                    continue
                add(label, m[1] or "<anon>", start, _close(code, pairs, m.end(), language != "csharp" or label == "namespace"))
        if language in ("c", "cpp"):
            for m in re.finditer(r"\btypedef\b", code):
                i = m.end()
                while (stop := re.compile(r"[(\[{;]").search(code, i)) and stop[0] != ";":
                    i = pairs[stop.start()] + 1
                if not stop:
                    break
                i = stop.start()
                add("typedef", _alias(code[m.end() : i]), m.start(), min(i + 1, len(code)))
        typed = [(i.start, i.end) for i in found if i.label in ("enum",)]
        for m in _FUNCTION.finditer(code):
            name = re.sub(r"\s+", "", m[1])
            base = name.split("::")[-1]
            if base in _NOT_NAMES or name in _NOT_NAMES or any(a < m.start() < b for a, b in typed):
                continue
            start = _head(code, m.start(), ":" if language == "cpp" and re.search(r"(?:public|private|protected)\s*$", code[: m.start()].rsplit(":", 1)[0][-12:]) and "::" not in code[_head(code, m.start()) : m.start()] else "")
            head = re.sub(r"^template\s*<[^{};]*?>\s*", "", code[start : m.start()])
            start = m.start() - len(head)
            if language == "csharp":
                if re.search(r"(?:=|=>|\bnew|\.)\s*$", head) or not head.strip() and not any(i.label in ("class", "struct") and i.name == name for i in found):
                    continue
            elif not head.strip() and "::" not in name and not name.startswith("~") and not any(i.name == name for i in found if i.label in ("class", "struct")):
                continue
            if re.search(r"[=,(]\s*$|\b(?:return|else|new)\s*$", head):
                continue
            if language == "c" and "*" in head:  # what the first star points to
                name = head[head.index("*") + 1 :].lstrip() + code[m.start() : pairs[code.index("(", m.end(1))] + 1]
            add("fn", name, start, pairs[m.end() - 1] + 1)
        if language in ("cpp", "csharp"):
            types = {_body(code, pairs, i.start): i.name for i in found if i.label in ("class", "struct", "interface")}
            heads = list((_UNBODIED if language == "cpp" else _MEMBER).finditer(code))
            for m, brace in zip(heads, around(pairs, [m.start(1) for m in heads]), strict=True):
                start = _head(code, m.start(1), ":" if language == "cpp" else "")
                head, after = code[start : m.start(1)], pairs[m.end()] + 1
                if language == "cpp":
                    if (brace in types or brace < 0 or "::" in m[1]) and (e := re.compile(r"[^;{}()=]*=\s*(?:default|delete)\s*;").match(code, after)):
                        add("fn", re.sub(r"\s+", "", m[1]), start, e.end())
                elif brace in types and m[1] not in _NOT_NAMES and (head.strip() or m[1] == types[brace]) and not re.search(r"[=(,.]|\b(?:delegate|new)\s*$", re.sub(r"\[[^\[\]]*\]|<[^;{}]*>", "", head)):
                    e = re.compile(r"[^;{}=]*(=>|;)").match(code, after)
                    end = _body(code, pairs, e.end()) if e and e[1] == "=>" else e.end() - 1 if e else None
                    while end is not None and code[end] == "{":
                        end = _body(code, pairs, pairs[end] + 1)
                    add("fn", m[1], start, None if end is None else end + 1)
    if language == "rust" or language in ("javascript", "typescript", "tsx"):
        return nest(found)
    out = nest(_not_in_functions(found))
    if language == "hlsl":  # both the walk and the scan find a buffer whose header is a mere name
        out += [replace(i, children=[]) for i in found if i.label == "cbuffer" and ":" not in i.signature]
        out.sort(key=lambda i: i.start)
    return out


#: words that can't be a type's new name
_NOT_ALIASES = frozenset("struct enum union class const volatile unsigned signed long short int char float double void bool _Bool size_t ssize_t ptrdiff_t intptr_t uintptr_t".split()) | {f"{u}int{n}_t" for u in ("", "u") for n in (8, 16, 32, 64)}


def _alias(text: str) -> str:
    """The last plain name of a type definition: the new one, or the type where the new one has a
    star, brackets or parameters; else ``<anon>``."""
    found, tokens = "<anon>", re.findall(rf"{_IDENT}|::|[^\s\w]", text) + [""]
    depth, pointer, before = 0, False, ""
    for n, t in enumerate(tokens[:-1]):
        if t in "([{<":
            depth += 1
        elif t in ")]}>":
            depth -= 1
        elif depth == 0:
            pointer = t != "," and (pointer or t in "*&")
            named = re.match(_IDENT, t) and t not in _NOT_ALIASES and before not in ("struct", "enum", "union", "class", "::")
            declared = tokens[n + 1] in ("[", "::", "<") or tokens[n + 1] == "(" and n > 0
            if named and not pointer and not declared:
                found = t
        before = t
    return found


def _not_in_functions(found: list[Item]) -> list[Item]:
    """Without function-like matches inside function bodies (calls before a block, local functions),
    but with the methods of types that are declared there."""
    bodies, types, kept = [], [], []
    for i in sorted(found, key=lambda i: (i.start, -i.end)):
        bodies = [b for b in bodies if i.start < b.end]
        types = [t for t in types if i.start < t.end]
        if i.label == "fn":
            if bodies and not any(t.start > bodies[-1].start for t in types):
                continue
            bodies.append(i)
        elif i.label in ("class", "struct", "interface"):
            types.append(i)
        kept.append(i)
    return kept
