"""Display, navigation, highlighting and drafts on small tables."""

import random

from pyspark.sql import functions as F

from codeatlas.functions import display
from codeatlas.operators import cache, chunks, highlight, navigation, pack
from codeatlas.plans import sources, views
from codeatlas.sources import git
from codeatlas.streaming import events


def test_wrap():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab é  ") for _ in range(rng.randint(0, 40)))
        n = rng.randint(1, 12)
        rows = display.wrap_rows(text, n)
        if len(text) <= n:
            assert rows == [text]
            continue
        assert "".join(rows).replace(" ", "") == text.replace(" ", "") and all(0 < len(r) <= n for r in rows)
        words = [w for w in text.split(" ") if w]
        for a, b in zip(rows, rows[1:], strict=False):  # a row ends only where the next word doesn't fit
            first = b.split(" ")[0]
            whole = [w for w in words if w.startswith(first)]
            assert len(a) + 1 + min(map(len, whole or [first])) > n or any(len(w) > n for w in words)
    assert display.wrap_rows("x", 0) == [] and display.wrap_rows("abcdef gh", 4) == ["abcd", "ef", "gh"]


def test_wrapped_paragraphs(spark):
    d = spark.createDataFrame([(1, "one  two\nthree\n\n\n\nfour", 9), (2, None, 9), (3, "x y", 1)], "k int, t string, b int")
    assert [r["rows"] for r in d.select("k", display.wrap_doc("t", "b").alias("rows")).orderBy("k").collect()] == [["one two", "three", "four"], [], []]


def test_gibibytes(spark):
    texts = ["1", "0.5", " 1.25 ", "1.000000000931322574615478515625", "", "x", "1.", ".5", "1.2.3", "-1", "99999999999", "99999999999999999999", "0.0", "1." + "0" * 40 + "1", "0.0000000001"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["p"] for r in d.select("i", display.parse_gibibytes("t").alias("p")).orderBy("i").collect()]
    assert [g["bytes"] for g in got[:4]] == [1 << 30, 1 << 29, 5 << 28, (1 << 30) + 1]
    number, large, precise, zero = "Disk cache must be a decimal number of GiB", "Disk cache size is too large", "Disk cache size is too precise", "Disk cache must be greater than zero GiB"
    assert [g["error"] for g in got[4:]] == [number] * 6 + [large, large, zero, precise, zero]
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1 << 45) for _ in range(300)] + [1, 1 << 30]
    back = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", display.parse_gibibytes(display.format_gibibytes("n"))["bytes"].alias("m"))
    assert back.where("n <> m or m is null").count() == 0


def test_texture_key(spark):
    row = spark.createDataFrame([(".\\a\\b.rs", -2, "item", "fn", "a/b.rs::x", 3, 7, 9)], "p string, s long, k string, l string, q string, o int, r long, t long")
    made = row.select(display.texture_key_bytes(*(F.col(c) for c in row.columns)).alias("b")).first()["b"]
    field = lambda b: len(b).to_bytes(8, "little") + b
    want = b"".join(map(field, [b"a/b.rs", (2**64 - 2).to_bytes(8, "little"), b"item:fn", b"a/b.rs::x", (3).to_bytes(4, "little"), (7).to_bytes(8, "little"), (9).to_bytes(8, "little")]))
    assert bytes(made) == want and git.fnv1a(b"") == 0xCBF29CE484222325


def test_cameras(spark):
    c = F.lit
    d = spark.range(1)
    x, y, z = display.zoom_about(c(300.0), c(200.0), c(5.0), c(6.0), c(2.0), c(1.5), 800.0, 600.0, 0.1, 8.0)
    before, after = display.screen_to_world(c(300.0), c(200.0), c(5.0), c(6.0), c(2.0), 800.0, 600.0), display.screen_to_world(c(300.0), c(200.0), x, y, z, 800.0, 600.0)
    r = d.select(*(v.alias(f"c{i}") for i, v in enumerate((*before, *after, z)))).first()
    assert abs(r[0] - r[2]) < 1e-9 and abs(r[1] - r[3]) < 1e-9 and r[4] == 3.0
    way = d.select(*(v.alias(f"c{i}") for i, v in enumerate((*display.tween((c(0.0), c(0.0), c(1.0)), (c(8.0), c(4.0), c(4.0)), c(0.125)), *display.tween((c(0.0), c(0.0), c(1.0)), (c(8.0), c(4.0), c(4.0)), c(0.3)), display.ease_out(c(2.0)))))).first()
    assert [round(v, 9) for v in way] == [4.0, 2.0, 2.0, 8.0, 4.0, 4.0, 1.0]


def test_history(spark):
    moves = [("push", "a"), ("push", "b"), ("back", None), ("push", "c"), ("forward", None), ("push", "d"), ("push", "e"), ("back", None), ("back", None), ("back", None)]
    d = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(moves)], "k int, i int, w string, t string")
    assert tuple(navigation.history(d, "k", "i", "w", "t", 3).first()) == (1, ["c", "d", "e"], 0)
    assert tuple(navigation.history(d.where("i < 5"), "k", "i", "w", "t").first()) == (1, ["a", "c"], 1)


def test_unfolded(spark):
    d = spark.createDataFrame([("a", 5, True), ("a/x", 2, False), ("a/x/q", 2, True), ("a/y", 2, True), ("b", 9, False), ("b/z", 9, True)], "path string, bytes long, expanded boolean")
    assert [r["path"] for r in navigation.unfolded(d).orderBy("order").collect()] == ["b", "a", "a/x", "a/y"]


def test_grouped_requests(spark):
    d = spark.createDataFrame([("p", 9.0, "f"), ("q", 8.0, "g"), ("r", 7.0, None), ("s", 2.0, "f"), ("t", 0.0, "f"), ("u", 1.0, "g")], "id string, area double, file string")
    got = cache.grouped_requests(d, "area", "id", "file", 6).orderBy("place").collect()
    assert [r["id"] for r in got] == ["p", "s", "q", "u", "r", "t"]


def test_highlight(spark):
    text = "// été\nfn go() { let x = \"a\nb\"; }\n"
    found = list(highlight.captures(text, "rust"))
    raw = text.encode()
    assert [(raw[a:b].decode(), c) for a, b, c in found] == [("// été", "comment"), ("fn", "keyword"), ("go", "function"), ("let", "keyword"), ('"a\nb"', "string")]
    d = spark.createDataFrame([(1, text, "rust")], "k long, text string, language string")
    lines = chunks.line_rows(d, "k", "text")
    got = highlight.line_spans(highlight.file_captures(d, "k"), lines, "k").join(lines, ["k", "line_no"])
    runs = got.select("line_no", highlight.runs(F.octet_length("text"), F.col("spans")).alias("r")).orderBy("line_no").collect()
    said = [[(r["n"], r["kind"]) for r in x["r"]] for x in runs]
    assert said[0] == [(8, "Comment")] and said[1][:3] == [(2, "Keyword"), (1, "Default"), (2, "Function")] and said[2] == [(2, "String"), (3, "Default")]
    assert list(highlight.captures("# T\n`c` [a](u)\n", "markdown")) == [(0, 3, "text.title"), (4, 7, "text.literal"), (12, 13, "text.uri")]
    assert list(highlight.captures("x = 1 # y\n", "toml")) == [(0, 1, "property"), (4, 5, "number"), (6, 9, "comment")] and list(highlight.captures("x", None)) == []
    for language, (source, items, _) in sources.SOURCES.items():
        kinds = {c for _, _, c in highlight.captures(source.replace("%", "1"), language)}
        assert kinds & {"keyword", "property", "function"}, language


def tree(spark):
    """Three levels: a root, folders, and files with items in them."""
    rows = [("r", None, "folder", 0, 0, [], 0, None)]
    for f in range(3):
        rows.append((f"f{f}", "r", "folder", 0, 1, ["r"], len(rows), "Test" if f == 1 else None))
        for p in range(2 + f):
            rows.append((f"f{f}p{p}", f"f{f}", "file", 10 * p + f, 2, ["r", f"f{f}"], len(rows), None))
            for i in range(2 if p == 0 else 0):
                rows.append((f"f{f}p{p}i{i}", f"f{f}p{p}", "item", 3 + i, 3, ["r", f"f{f}", f"f{f}p{p}"], len(rows), "Docs"))
    d = spark.createDataFrame(rows, "id string, parent_id string, kind string, measure long, depth int, anc array<string>, pre long, own_role string")
    return rows, d.withColumns({"label": F.when(F.col("kind") == "item", "fn"), "path": F.col("id"), "name": F.col("id"), "ordinal": F.lit(0), "role": F.lit(0), "byte_start": F.lit(None).cast("long")})


def test_small_sources_are_many_tasks_and_few_frames(spark, sf, monkeypatch):
    files = views._files(spark, sf)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files.rdd.getNumPartitions() == n > 1
    made = []
    frame = highlight.pd.DataFrame
    monkeypatch.setattr(highlight, "BATCH", 50)
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, run, schema: made.append(run) or self)
    highlight.file_captures(files, "key")
    some = files.select("key", "text", "language").limit(40).toPandas()
    got = list(made[0](iter([some])))
    assert [r for f in got for r in f.itertuples(index=False, name=None)] == [(k, *c) for k, t, x in some.itertuples(index=False) for c in highlight.captures(t, x)]
    assert len(got) < 20 and all(type(f) is frame and len(f) >= 50 for f in got[:-1])


def test_postorder(spark):
    rows, d = tree(spark)
    order, roles = [], {}

    def walk(node, inherited):
        for r in rows:
            if r[1] == node[0]:
                walk(r, (r[7] or inherited) if node[2] == "folder" else "Source")
        order.append(node[0])
        roles[node[0]] = inherited

    walk(rows[0], "Source")
    got = pack.postorder(d).orderBy("post").collect()
    assert [r["id"] for r in got] == order and {r["id"]: r["inherited"] for r in got} == roles and [r["post"] for r in got] == list(range(len(rows)))


def test_progressive_layout(spark):
    """Every snapshot against the recursive definition: what is done as packed, the rest stacked."""
    rows, d = tree(spark)
    cfg = pack.PackConfig()
    post = pack.postorder(d)
    place = {r["id"]: r["post"] for r in post.collect()}
    whole = {r["id"]: r for r in pack.pack(d, cfg).collect()}
    kids = {r[0]: [x for x in rows if x[1] == r[0]] for r in rows}

    def layout(done):
        def size(r):
            if not kids[r[0]]:
                return cfg.page_w, cfg.header + (1 + r[3]) * cfg.line_step + cfg.bottom_pad, {}
            if done(r[0]):
                me = whole[r[0]]
                return me["w"], me["h"], {k[0]: (whole[k[0]]["x"] - me["x"], whole[k[0]]["y"] - me["y"]) for k in kids[r[0]]}
            y, at, w = cfg.container_header + cfg.gap, {}, 0.0
            for k in kids[r[0]]:
                a, b, _ = size(k)
                at[k[0]], w, y = (cfg.gap, y), max(w, a), y + b + cfg.gap
            return w + 2 * cfg.gap, y, at

        out = {}

        def put(r, x, y):
            w, h, at = size(r)
            out[r[0]] = (x, y, w, h)
            for k in kids[r[0]]:
                put(k, x + at[k[0]][0], y + at[k[0]][1])

        put(rows[0], 0.0, 0.0)
        return out

    got = {}
    for r in pack.progressive(d, post, 5, cfg).collect():
        got.setdefault(r["completed"], {})[r["id"]] = tuple(r[c] for c in "xywh")
    n = len(rows)
    marks = [-(-k * n // 4) for k in range(1, 4)]
    steps = {min(place[i] + 1 for i in kids if kids[i] and place[i] + 1 >= m) for m in marks}
    assert set(got) == {0, n} | {s for s in steps if s < n} and len(got) > 2
    for step, rects in got.items():
        want = layout(lambda i: step == n or place[i] < step)  # noqa: B023
        assert set(rects) == set(want) and all(abs(a - b) < 1e-6 for i in want for a, b in zip(rects[i], want[i], strict=True)), step


def test_generations(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (1, "c")], "generation int, what string")
    assert sorted(r["what"] for r in events.current(d).collect()) == ["b", "b"]
    loads = events.Loads(spark)
    first, second = loads.start(), loads.start()
    assert (first, second) == ("codeatlas-load-1", "codeatlas-load-2") and second in spark.getTags() and first not in spark.getTags()
    loads.cancel()
    assert second not in spark.getTags()


def test_candidates_and_symbols(spark):
    d = spark.createDataFrame([("f", "f", "file", 0), ("f", "f::a", "item", 9), ("f", "f::b", "item", 4), ("g", "g", "file", 0), ("h", "h", "file", None)], "file string, id string, kind string, byte_start long")
    got = {r["file"]: [tuple(s) for s in r["symbols"]] for r in navigation.file_symbols(d).collect()}
    assert got == {"f": [(4, "f::b"), (9, "f::a")], "g": [(0, "g")], "h": []}
    assert navigation.candidates(d, "file").count() == 3 and navigation.candidates(d, "symbol").count() == 5


def test_texture_query(spark, sf):
    got = {r["id"]: r["key"] for r in views.texture_keys(spark, sf).collect()}
    nodes = views._nodes4(spark, sf).limit(20).collect()
    field = lambda b: len(b).to_bytes(8, "little") + b
    for n in nodes:
        kind = "item:" + n["label"] if n["kind"] == "item" else n["kind"]
        parts = [f"src/{n['p_brand']}".encode(), n["id"].to_bytes(8, "little"), kind.encode(), f"{n['p_brand']}::{n['name']}".encode(), (n["id"] % 4).to_bytes(4, "little"), (7).to_bytes(8, "little"), b"\xff" * 8]
        assert got[n["id"]] == f"{git.fnv1a(b''.join(map(field, parts))):016x}"
