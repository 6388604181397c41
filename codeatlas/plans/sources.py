"""Small sources in each parsed language, a number within every name, and what is in them.

``%`` stands for the number. For each language: the text, its items (label, name, lines, depth) in
source order, and the calls of its last function (name, receiver)."""

SOURCES: dict[str, tuple[str, list[tuple[str, str, int, int]], list[tuple[str, str | None]]]] = {
    "rust": (
        "/// Counts %.\npub struct Tally% {\n    n: u32,\n}\nimpl Tally% {\n    fn bump%(&mut self) { self.n += 1; }\n}\nmod deep% {\n    pub enum Shade% { Dark, Light }\n}\nfn total%(t: &mut Tally%) -> u32 {\n    t.bump%();\n    audit::note%(t.n);\n    t.n\n}\n",
        [("struct", "Tally%", 3, 1), ("impl", "Tally%", 3, 1), ("fn", "bump%", 1, 2), ("module", "deep%", 3, 1), ("enum", "Shade%", 1, 2), ("fn", "total%", 5, 1)],
        [("bump%", "t"), ("audit::note%", None)],
    ),
    "python": (
        "class Ledger%:\n    def open%(self):\n        return 1\n\n@traced\ndef settle%(book):\n    book.open%()\n    close%(book)\n",
        [("class", "Ledger%", 3, 1), ("fn", "open%", 2, 2), ("fn", "settle%", 4, 1)],
        [("open%", "book"), ("close%", None)],
    ),
    "javascript": (
        "class Queue% {\n  take%() { return this.head; }\n}\nconst drain% = (q) => q.take%();\nfunction run%(q) {\n  drain%(q);\n  q.stop%();\n}\n",
        [("class", "Queue%", 3, 1), ("fn", "take%", 1, 2), ("fn", "drain%", 1, 1), ("fn", "run%", 4, 1)],
        [("drain%", None), ("stop%", "q")],
    ),
    "typescript": (
        "interface Shape% { area: number; }\nenum Tone% { Low, High }\ntype Pair% = { a: number };\nfunction fill%(s: Shape%): void {\n  paint%(s);\n}\n",
        [("interface", "Shape%", 1, 1), ("enum", "Tone%", 1, 1), ("type", "Pair%", 1, 1), ("fn", "fill%", 3, 1)],
        [("paint%", None)],
    ),
    "c": (
        "struct Cell% { int v; };\nenum Mode% { ON, OFF };\ntypedef unsigned char byte%;\nint probe%(struct Cell% *c) {\n  if (c) { poke%(c); }\n  return 0;\n}\n",
        [("struct", "Cell%", 1, 1), ("enum", "Mode%", 1, 1), ("typedef", "byte%", 1, 1), ("fn", "probe%", 4, 1)],
        [("poke%", None)],
    ),
    "cpp": (
        "namespace grid% {\nclass Node% {\npublic:\n  int depth%() const { return d; }\n};\n}\nvoid walk%(int n) {\n  visit%(n);\n}\n",
        [("namespace", "grid%", 6, 1), ("class", "Node%", 4, 2), ("fn", "depth%", 1, 3), ("fn", "walk%", 3, 1)],
        [("visit%", None)],
    ),
    "csharp": (
        "namespace Shop% {\npublic interface ISell% { void Sell(); }\npublic class Till% {\n  public int Ring%(int a) { Log%(a); return a; }\n}\n}\n",
        [("namespace", "Shop%", 6, 1), ("interface", "ISell%", 1, 2), ("fn", "Sell", 1, 3), ("class", "Till%", 3, 2), ("fn", "Ring%", 1, 3)],
        [("Log%", None)],
    ),
    "glsl": (
        "struct Ray% { vec3 o; };\nfloat dim%(float x) { return x; }\nvoid main%() {\n  dim%(1.0);\n}\n",
        [("struct", "Ray%", 1, 1), ("fn", "dim%", 1, 1), ("fn", "main%", 3, 1)],
        [],
    ),
    "hlsl": (
        "cbuffer Scene% : register(b0) { float4 sun; };\nfloat4 shade%(float4 p) {\n  return p;\n}\n",
        [("cbuffer", "Scene%", 1, 1), ("fn", "shade%", 3, 1)],
        [],
    ),
    "make": (
        "FLAGS% = -O2\n\nbuild%: main.o\n\tcc main.o\n\nclean%:\n\trm -f main.o\n",
        [("section", "Variables", 2, 1), ("target", "build%", 2, 1), ("section", "Section", 1, 1), ("target", "clean%", 2, 1)],
        [],
    ),
}
EXTENSIONS = {"rust": "rs", "python": "py", "javascript": "js", "typescript": "ts", "c": "c", "cpp": "cpp", "csharp": "cs", "glsl": "glsl", "hlsl": "hlsl", "make": "mk"}
