"""Parsers, calls and bindings on small sources."""

import pytest

from codeatlas.parse import registry, rows
from codeatlas.plans import sources

CASES = {
    "rust": ("#[derive(Clone)]\npub(crate) struct Route { hops: u8 }\nimpl Iterator for Route {\n type Item = u8;\n fn next(&mut self) -> Option<u8> { None }\n}\npub mod wire { pub async fn send() {} const fn pad() -> u8 { 0 } }\ntrait Hop { fn cost(&self) -> u8 { 1 } }\nfn plan(f: impl Fn(u8)) { let note = \"struct Fake {\"; /* fn hidden() {} */ }\n", [("struct", "Route", 0), ("impl", "Iterator for Route", 1), ("module", "wire", 2), ("trait", "Hop", 1), ("fn", "plan", 0)]),
    "python": ("import os\n\nclass Kettle(Base):\n  \"\"\"Boils.\"\"\"\n  async def boil(self): pass\n  @property\n  def hot(self): return True\n  def pour(self):\n    def drip(): pass\n@retry(3)\nasync def brew(leaf): pass\n", [("class", "Kettle", 3), ("fn", "brew", 0)]),
    "javascript": ("export default class Dial {\n  constructor(min) { this.min = min; }\n  static of(x) { while (x) { x--; } return new Dial(x); }\n  get mid() { return 1; }\n}\nlet twice = async (n) => { return n * 2; };\nasync function* ticks() { yield 1; }\nconst plain = 3;\n", [("class", "Dial", 3), ("fn", "twice", 0), ("fn", "ticks", 0)]),
    "typescript": ("export interface Plug { volts: number; }\nconst enum Side { L, R }\ntype Maybe<T> = T | { none: true };\nabstract class Socket { private on(p: Plug): boolean { return !!p; } }\nexport const join = <T,>(a: T): T => a;\nfunction cut(s: Side): void {}\n", [("interface", "Plug", 0), ("enum", "Side", 0), ("type", "Maybe", 0), ("fn", "on", 0), ("fn", "join", 0), ("fn", "cut", 0)]),
    "c": ("#include <stdio.h>\nstruct Gear { int teeth; };\nstruct Gear later;\nenum Turn { CW, CCW };\ntypedef struct Axle { struct Gear *g; } axle_t;\nstatic int spin(struct Gear *g, int n) { for (;;) { if (n) { break; } } return 0; }\n", [("struct", "Gear", 0), ("enum", "Turn", 0), ("typedef", "axle_t", 1), ("fn", "spin", 0)]),
    "cpp": ("namespace mill {\nstruct Sack { int kg; };\nenum class Grain { Rye, Oat };\nclass Wheel : public Part { public: Wheel(int r) : radius(r) {} ~Wheel() {} int turn() const { return grind(); } };\n}\ntemplate <class T> T larger(T a, T b) { return a > b ? a : b; }\nvoid mill::Wheel::stop() { brake(); }\n", [("namespace", "mill", 3), ("fn", "larger", 0), ("fn", "mill::Wheel::stop", 0)]),
    "csharp": ("namespace Depot {\npublic sealed class Crate { public Crate() {} internal int Weigh(int n) { return n; } }\npublic record Label(string Text);\ninterface IMove { void Go(); }\npublic enum Dock { North }\nstruct Pallet { int n; }\n}\n", [("namespace", "Depot", 5)]),
    "glsl": ("layout(std140) uniform Sky { vec4 hue; };\nstruct Fog { float near; };\nfloat haze(Fog f) { return f.near; }\nvoid main() { haze(g); }\n", [("interface", "Sky", 0), ("struct", "Fog", 0), ("fn", "haze", 0), ("fn", "main", 0)]),
    "hlsl": ("struct Vert { float3 at; };\ncbuffer Wind : register(b2) { float4 gust; };\nfloat4 bend(Vert v) : SV_Position { return float4(v.at, 1); }\n", [("struct", "Vert", 0), ("cbuffer", "Wind", 0), ("fn", "bend", 0)]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_items(language):
    source, want = CASES[language]
    assert [(i.label, i.name, len(i.children)) for i in registry.parse(source.encode(), language)] == want


@pytest.mark.parametrize("language", sorted(sources.SOURCES))
def test_sample_sources(language):
    text, want, _ = sources.SOURCES[language]
    source, found = text.replace("%", "12").encode(), []

    def add(items, depth):
        for i in items:
            found.append((i.label, i.name, rows(source, i.start, i.end), depth))
            add(i.children, depth + 1)

    add(registry.parse(source, language), 1)
    assert found == [(a, b.replace("%", "12"), n, d) for a, b, n, d in want]


def shown(source, language):
    return [(i.label, i.name, [(c.label, c.name) for c in i.children], source.encode()[i.start : i.end].decode()) for i in registry.parse(source.encode(), language)]


def test_rust_headers_and_comments():
    src = "/* outer /* inner } */ still { */\nfn sum(xs: [u8; 4]) -> [u8; 2] { let q = '{'; let s: &'static str = \"}\"; [0; 2] }\nstruct Key([u8; 32], char);\nconst fn zero() {}\nfn hash() { r##\"}\"# \"##; b'}'; }\n"
    assert [(x, n) for x, n, *_ in shown(src, "rust")] == [("fn", "sum"), ("struct", "Key"), ("fn", "zero"), ("fn", "hash")]
    assert shown(src, "rust")[1][3] == "struct Key([u8; 32], char);"


def test_script_values_and_methods():
    src = "const lid = /[}/{]+\\/}/g;\nconst box = {\n  open(n) { return n / 2 / 3; },\n  async *each() {},\n  [Symbol.iterator]() { return 1; },\n  shut: function () {},\n};\nfunction draw({ x, y }, z = { w: 1 }) { if (x) { return `a${ [y].map((v) => { return `}`; }) }}`; } }\nconst Held = class extends Base { keep() {} };\nexport const long = (a) =>\n  a\n    .b()\n    .c();\nexport default class Jar {}\nuse(function hidden() {});\n"
    got = shown(src, "javascript")
    assert [(x, n) for x, n, *_ in got] == [("fn", "open"), ("fn", "each"), ("fn", "[Symbol.iterator]"), ("fn", "draw"), ("fn", "keep"), ("fn", "long"), ("class", "Jar")]
    assert got[5][3] == "const long = (a) =>\n  a\n    .b()\n    .c();" and got[6][3] == "class Jar {}"
    ts = "export declare function gone(a: { b: number }): void;\nfunction pick(o: { a: number; b: string }): { c: number } { return { c: o.a }; }\nexport type Way = {\n  a: number;\n} | null;\nclass Pump<T extends { n: number }> { @Log() go(at: { x: number }): { y: number } { return { y: 1 }; } halt = () => { while (on()) { off(); } }; }\n"
    assert [(x, n, c) for x, n, c, _ in shown(ts, "typescript")] == [("fn", "pick", []), ("type", "Way", []), ("class", "Pump", [("fn", "go")])]
    assert shown(ts, "typescript")[1][3] == "type Way = {\n  a: number;\n} | null;"


def test_c_names():
    src = "typedef struct { int x; } Dot;\ntypedef Dot *DotRef;\ntypedef int (*Hook)(Dot);\ntypedef unsigned long word, words[4];\nenum { RED };\nstatic char *label(int n) { char c = '{'; return names[n]; }\n"
    assert [(x, n, c) for x, n, c, _ in shown(src, "c")] == [("typedef", "Dot", [("struct", "<anon>")]), ("typedef", "Dot", []), ("typedef", "<anon>", []), ("typedef", "word", []), ("enum", "<anon>", []), ("fn", "label(int n)", [])]
    cpp = "namespace {\nclass Tap { public: Tap() = default; Tap(const Tap &) = delete; bool operator==(const Tap &o) const { return n == 1'000; } };\n}\nTap *make() { struct Part { int one() { return 1; } }; return nullptr; }\n"
    got = shown(cpp, "cpp")
    assert [(x, n, c) for x, n, c, _ in got] == [("namespace", "<anon>", [("class", "Tap")]), ("fn", "make", [("struct", "Part")])]
    tap = registry.parse(cpp.encode(), "cpp")[0].children[0]
    assert [i.name for i in tap.children] == ["Tap", "Tap", "operator=="]


def test_csharp_members():
    src = "namespace Yard;\ninterface IHaul { void Load(int n); Task<int> Drop<T>(T a) where T : new(); int Size { get; } }\nabstract class Cart : IHaul {\n  [Old] public abstract void Roll();\n  public int Twice(int n) => Add(n, n);\n  string s = $@\"a\"\"}\" + \"\"\"}\"\"\";\n  int Add(int a, int b) { int Inner(int q) { return q; } return Inner(a) + b; }\n}\n"
    assert [(x, n, c) for x, n, c, _ in shown(src, "csharp")] == [("interface", "IHaul", [("fn", "Load"), ("fn", "Drop")]), ("class", "Cart", [("fn", "Roll"), ("fn", "Twice"), ("fn", "Add")])]


def test_hlsl_buffers_of_a_mere_name_come_twice():
    assert [(x, n) for x, n, *_ in shown("cbuffer Lamp { float4 c; };\ncbuffer Fan : register(b1) { float s; };\n", "hlsl")] == [("cbuffer", "Lamp"), ("cbuffer", "Lamp"), ("cbuffer", "Fan")]


def test_signature_and_docs():
    src = "//! top\n//! more\n/// Doc.\n/// Two.\n#[inline]\nfn multi(\n  a: i32,\n  b: i32,\n) -> i32 { 1 }\n//// no\nfn other() {}\n"
    one, two = registry.parse(src.encode(), "rust")
    assert one.signature == "fn multi( a: i32, b: i32, ) -> i32" and one.doc == "Doc.\nTwo." and two.doc is None
    assert registry.doc(src.encode(), "rust") == "top\nmore"


def test_make_covers_all():
    m = "# top\nCC = gcc\n\nall: a b\n\tcc x\n\tcc y\n\nifdef X\nY=1\nendif\n%.o: %.c\n\t$(CC) $<\nclean install:\n\trm x\n"
    it = registry.parse(m.encode(), "make")
    assert "".join(m[i.start : i.end] for i in it) == m
    assert [i.name for i in it if i.label == "target"] == ["all", "%.o", "clean install"]


def test_broken_python_recovers():
    assert [i.name for i in registry.parse(b"def ok():\n    pass\ndef bad(:\n  x\nclass C:\n  def m(self): pass\n", "python")] == ["ok", "bad", "C"]


def test_calls():
    assert [c[0] for c in registry.calls(b"fn main() { foo(); Bar::baz(); obj.method(); foo(); }", "rs", 0, 60)] == ["foo", "Bar::baz", "method"]
    assert registry.calls(b"def f(d):\n  d.speak(); g(); g()\n", "py", 0, 60) == [("speak", 12, 21, "d"), ("g", 23, 26, None)]
    assert registry.calls(b"x", "txt", 0, 1) == []


def test_bindings():
    src = b"class Foo:\n  def m(self, a: Bar, b=1):\n    d = Dog()\n    c: Cat = x\n    e = mk()\n    a = Dog()\n"
    assert registry.bindings(src, "py", 13, 100, "Foo", {"Dog"}, {"mk": "Z"}) == {"self": "Foo", "a": "Bar", "d": "Dog", "c": "Cat", "e": "Z"}
    ts = b"m(a: Bar, b?: Baz) { const d = new Dog(); let c: Cat = x; const e = mk(); }"
    assert registry.bindings(ts, "ts", 0, len(ts), "Foo", set(), {"mk": "Z"}) == {"this": "Foo", "a": "Bar", "b": "Baz", "d": "Dog", "c": "Cat", "e": "Z"}


def test_bindings_walk_a_file_once(monkeypatch):
    from codeatlas.parse import python

    source = b"class A:\n" + b"".join(b"    def f%d(self, x: A):\n        y = A()\n" % i for i in range(20))
    walked = []
    walk = python.ast.walk
    monkeypatch.setattr(python.ast, "walk", lambda n: walked.append(n) or walk(n))
    functions = registry.parse(source, "python")[0].children
    assert [registry.bindings(source, "py", f.start, f.end, "A", {"A"}, {}) for f in functions] == [{"self": "A", "x": "A", "y": "A"}] * 20
    assert sum(isinstance(n, python.ast.Module) for n in walked) == 2  # for the items, and for all bindings
