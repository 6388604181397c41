"""Operators on small tables with known results."""

import functools
import math
import operator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeatlas.operators import cache, calls, chunks, churn, hierarchy, ordered, pack, spans, view
from codeatlas.plans import registry


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_percentiles(spark):
    d = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 20)], "id int, n long")
    want = [(1, 0.0), (2, 1 / 3), (3, 1.0), (4, 1 / 3)]
    assert rows(hierarchy.percentile(d, "n"), "id", "percentile") == want
    assert rows(hierarchy.percentile_by_counts(d, "n"), "id", "percentile") == want
    assert rows(hierarchy.percentile_by_counts(d.where("id = 1"), "n"), "percentile") == [(0.0,)]
    assert hierarchy.percentile_by_counts(d.where("id > 9"), "n").count() == 0


def test_log(spark):
    log = ["abc", "", "1\t2\tsrc/main.rs", "-\t-\tlogo.png", "x\t1\tno", "3\t0\tsrc/main.rs", "1\t1\tREADME.md", "4\t4\tsrc/main.rs"]
    d = churn.counts_from_log(spark.createDataFrame([(x,) for x in log], "line string"))
    assert rows(d, "path", "commits") == [("README.md", 1), ("logo.png", 1), ("src/main.rs", 3)]


def test_ordinals_and_dedupe(spark):
    d = spark.createDataFrame([("r", "beta", 0), ("r", "alpha", 1), ("r", "alpha", 2)], "parent string, name string, o int")
    assert rows(hierarchy.sibling_ordinals(d, "parent", "name", "o"), "name", "ordinal") == [("alpha", 0), ("alpha", 1), ("beta", 0)]
    d = spark.createDataFrame([("k", 0, 1), ("k", 0, 2), ("k", 5, 3), ("k", 1, 4), ("j", 3, 5)], "k string, ord int, pre int")
    assert rows(hierarchy.dedupe_ids(d, ["k"], "ord", "pre"), "pre", "new_ordinal") == [(1, 0), (2, 1), (3, 5), (4, 6), (5, 3)]


def test_dominance(spark):
    d = spark.createDataFrame([(f"a/{i}", "Test" if i < 7 else "Source") for i in range(10)] + [(f"b/{i}", "Test" if i < 6 else "Docs") for i in range(10)], "path string, role string")
    assert rows(hierarchy.dominant_role(d).where("folder <> ''"), "folder", "role", "strong") == [("a", "Test", True), ("b", "Source", False)]


def test_nearest_strong(spark):
    p = spark.createDataFrame([("t/a/b",), ("u/x",), ("t/s",)], "path string")
    s = spark.createDataFrame([("t", "Test"), ("t/s", "Docs")], "path string, role string")
    assert rows(hierarchy.nearest_strong(p, s), "path", "role") == [("t/a/b", "Test"), ("t/s", "Docs"), ("u/x", "Source")]


def labels(spark, lines, size=60):
    d = spark.createDataFrame([(1, lines)], "k int, l array<string>")
    return [tuple(r) for r in chunks.headings(d, "k", "l").orderBy("chunk").select("start_line", "end_line", "label").collect()]


def test_heading_chunks(spark):
    assert labels(spark, ["# Alpha", "a", "b", "## Beta", "c"]) == [(0, 3, "Alpha"), (3, 5, "Beta")]
    assert labels(spark, ["intro", "# A", "x", "# Beta", "y"]) == [(0, 3, "1–3"), (3, 5, "Beta")]
    assert labels(spark, ["# H"] + ["x"] * 65 + ["", "tail"]) == [(0, 66, "H"), (66, 68, "67–68")]
    assert labels(spark, []) == []


def test_line_chunks(spark):
    d = spark.createDataFrame([(1, "".join(f"l{i}\n" for i in range(150))), (2, None), (3, "é\r\nb")], "k int, t string")
    li = chunks.line_rows(d, "k", "t")
    assert [r["label"] for r in chunks.fixed(li.where("k = 1"), "k").orderBy("chunk").collect()] == ["1–60", "61–120", "121–150"]
    assert rows(li.where("k > 1"), "k", "line_no", "start_byte", "end_byte", "text") == [(3, 0, 0, 4, "é"), (3, 1, 4, 5, "b")]


def test_calls(spark):
    f = spark.createDataFrame([("a.py::Dog::speak", "speak"), ("a.py::Cat::speak", "speak"), ("a.rs::Bar::baz", "baz"), ("b.rs::Foo::baz", "baz"), ("a.py::main", "main")], "path string, name string")
    c = spark.createDataFrame([("a.py::main", "speak", 5, "d"), ("a.py::main", "Bar::baz", 9, None), ("a.py::main", "main", 11, None)], "caller string, name string, site long, receiver string")
    assert rows(calls.callees(c, f), "target") == [("a.py::Cat::speak",), ("a.py::Dog::speak",), ("a.rs::Bar::baz",)]
    b = spark.createDataFrame([("a.py::main", "d", "Dog", 0), ("a.py::main", "d", "Cat", 1)], "caller string, receiver string, class string, seq int")
    assert rows(calls.callees(c, f, calls.first_bindings(b)), "target") == [("a.py::Dog::speak",), ("a.rs::Bar::baz",)]
    assert rows(calls.callers(c, f), "target", "caller") == [(t, "a.py::main") for t in ("a.py::Cat::speak", "a.py::Dog::speak", "a.rs::Bar::baz", "b.rs::Foo::baz")]
    assert calls.edges(c, f).count() == 7


def test_anchors(spark):
    def move(pos, edits):
        e = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("new_len")) for a, b, n in edits))
        return spark.range(1).select(spans.remap(F.lit(pos), e).alias("v")).first()["v"]

    assert [move(100, [(50, 50, 10), (200, 200, 5), (105, 120, 1)][:n]) for n in (1, 2, 3)] == [110, 110, 105]
    assert move(30, [(20, 40, 0)]) == 20
    assert [move(50, [(50, 60, 1)]), move(50, [(50, 60, 1), (50, 50, 4)])] == [50, 54]
    assert [move(p, [(15, 25, 2)]) for p in (10, 20, 30)] == [10, 15, 22]


def test_greedy_spans(spark):
    s = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 8), (0, 4), (0, 6), (6, 7), (8, 9))))
    got = spark.range(1).select(spans.without_overlap(s).alias("v")).first()["v"]
    assert [tuple(x) for x in got] == [(0, 6), (6, 7), (8, 9)]


def test_nearest(spark):
    def step(rects, direction, cell=7.0):
        d = spark.createDataFrame([(i, *map(float, r), 1) for i, r in rects.items()], "id string, x double, y double, w double, h double, depth int")
        return {r["id"]: r["neighbour"] for r in view.nearest(d, direction, cell).collect()}.get("c")

    assert step({"c": (0, 0, 10, 10), "p": (-60, 2, 10, 6), "q": (-15, 11, 10, 10)}, "left") == "p"
    assert step({"c": (0, 0, 10, 10), "q": (-15, 11, 10, 10)}, "left") is None
    assert step({"c": (0, 0, 10, 10), "p": (20, 0, 10, 10), "q": (14, -30, 10, 50)}, "right") == "q"
    assert step({"c": (0, 0, 10, 10), "p": (10, 0, 10, 10), "q": (10, 10, 10, 10)}, "right") == "p"
    assert step({"c": (0, 0, 10, 10), "q": (10, 10, 10, 10)}, "down") is None


def test_lru(spark):
    d = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 3)], "k int, bytes int, t int")
    assert rows(cache.lru_keep(d, 10, "bytes", "t", "k"), "k") == [(2,), (3,)]


@pytest.fixture
def many_ranges(spark):
    """Small tables keep more than one partition."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_lru_of_all_rows(spark, many_ranges):
    sizes = [(i * 37 % 11, i) for i in range(500)] + [(None, 500), (3, 501)]
    d = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(sizes)], "k int, bytes long, t int").repartition(7)
    kept, used = [], 0
    for i, (b, _) in reversed(list(enumerate(sizes))):
        used += b or 0
        if used <= 400:
            kept.append((i, used))
    got = cache.lru_keep(d, 400, "bytes", "t", "k")
    assert sorted((r.k, r.used) for r in got.collect()) == sorted(kept)
    assert cache.lru_keep(d.where("k < 0"), 400, "bytes", "t", "k").count() == 0


def test_rank_over_ranges(spark, many_ranges):
    d = spark.range(5000).select(F.xxhash64("id").alias("x"), F.array(F.col("id") % 13, F.col("id")).alias("positions"))
    got = ordered.rank(d, F.col("x"), out="r").collect()
    assert [r.r for r in sorted(got, key=lambda r: r.x)] == list(range(5000)) and d.columns == ["x", "positions"]
    tree = hierarchy.preorder(d).collect()
    assert [r.pre for r in sorted(tree, key=lambda r: r.positions)] == list(range(5000))


def test_rank_has_no_window_over_all_rows(spark):
    plan = ordered.rank(spark.range(5000).toDF("x"), F.desc("x"))._jdf.queryExecution().executedPlan().toString()
    # the only exchange into one partition is that of one row a range
    assert plan.count("Exchange SinglePartition") == 1 and "BroadcastExchange" in plan


def test_skyline():
    pos, used = pack.place([(6, 4), (4, 2), (4, 2)], 0, 10)
    assert pos == [(0, 0), (6, 0), (6, 2)] and used == (10, 4)
    pos, _ = pack.place([(6, 4), (4, 2), (4, 2)], 1, 12)
    assert pos[1:] == [(7, 0), (7, 3)]


def test_milestones(spark):
    got = [spark.range(1).select(pack.milestones(F.lit(t).cast("long"), s).alias("v")).first()["v"] for t, s in ((10, 0), (10, 4), (3, 30))]
    assert got == [[0, 10], [0, 4, 7, 10], [0, 1, 2, 3]]


CFG = pack.PackConfig(640, 15.6, 20.8, 52, 6, 8, 1.6, None)


def tree(spark, nodes):
    cols = "id string, parent_id string, kind string, label string, path string, name string, ordinal int, role int, byte_start long, measure long, depth int, anc array<string>"
    return spark.createDataFrame(nodes, cols)


def test_pack_golden(spark):
    n = tree(spark, [
        ("r", None, "folder", None, "", "r", 0, 0, None, 111, 0, []),
        ("a.rs", "r", "file", None, "a.rs", "a.rs", 0, 0, 0, 100, 1, ["r"]),
        ("b.rs", "r", "file", None, "b.rs", "b.rs", 0, 0, 0, 11, 1, ["r"]),
        ("f", "b.rs", "item", "fn", "b.rs::f", "f", 0, 0, 0, 10, 2, ["r", "b.rs"]),
        ("g", "b.rs", "item", "fn", "b.rs::g", "g", 0, 0, 50, 1, 2, ["r", "b.rs"]),
    ])
    got = {r["id"]: tuple(round(v, 6) for v in (r["x"], r["y"], r["w"], r["h"])) for r in pack.pack(n, CFG).collect()}
    assert got == {"a.rs": (8, 60, 640, 1602.4), "f": (664, 120, 640, 198.4), "g": (664, 326.4, 640, 58), "b.rs": (656, 60, 656, 332.4), "r": (0, 0, 1320, 1670.4)}


def test_pack_many(spark):
    n = tree(spark, [("r", None, "folder", None, "", "r", 0, 0, None, 0, 0, [])] + [(f"f{i}", "r", "file", None, f"f{i}", f"f{i}", 0, i % 6, 0, i % 17 + 1, 1, ["r"]) for i in range(540)])
    got = pack.pack(n).toPandas()
    assert len(got) == 541
    kids = got[got["id"] != "r"].reset_index(drop=True)
    root = got[got["id"] == "r"].iloc[0]
    assert ((kids.x >= 8) & (kids.x + kids.w <= root.w - 8 + 1e-6) & (kids.y + kids.h <= root.h - 8 + 1e-6)).all()
    pairs = kids.merge(kids, how="cross")
    pairs = pairs[pairs.id_x < pairs.id_y]
    apart = (pairs.x_x + pairs.w_x + 8 <= pairs.x_y + 1e-6) | (pairs.x_y + pairs.w_y + 8 <= pairs.x_x + 1e-6) | (pairs.y_x + pairs.h_x + 8 <= pairs.y_y + 1e-6) | (pairs.y_y + pairs.h_y + 8 <= pairs.y_x + 1e-6)
    assert apart.all()


def test_source_order():
    kids = pd.DataFrame([("a", "item", "fn", "z", 0, 0, 0.0, 640.0, 73.6), ("b", "item", "struct", "a", 0, 0, 100.0, 640.0, 400.0)], columns="id kind label name ordinal role byte_start w h".split())
    pos, _ = pack.arrange(kids, "file", "x.cpp", CFG)
    assert [p[0] for p in pos] == ["a", "b"]
    pos, _ = pack.arrange(kids, "file", "x.rs", CFG)
    assert [p[0] for p in pos] == ["b", "a"]


def test_content_fingerprint(spark, tmp_path):
    texts = [None, "", "hello", "é 日本 😀", "line\n" * 20_000, "line\n" * 20_000 + "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(data):
        h = 14695981039346656037
        for b in data:
            h = ((h ^ b) * 1099511628211) % 2**64
        return f"{h:016x}"

    got = dict(rows(registry.QUERIES["content_fingerprint"](spark, str(tmp_path)), "doc_id", "fingerprint"))
    assert got == {i: None if t is None else brute(t.encode()) for i, t in enumerate(texts)}
    assert got[1] == "cbf29ce484222325" and got[2] == "a430d84680aabd0b"


def test_every_called_name_is_a_function(spark, tmp_path):
    said = [(1, 0, "the cat the"), (1, 1, "cat sat"), (2, 0, None), (2, 1, ""), (3, 0, "almond then")]
    parts = [(7, "almond red"), (8, "sat blue"), (9, "almond"), (10, None)]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    called = {}
    for c, t, x in said:
        for i, w in enumerate([] if x is None else x.split(" "), 1):
            called.setdefault((f"f/{c}::t{t}", w), i)
    functions = {(f"p/{k}::{n.split(' ')[0]}", n.split(" ")[0]) for k, n in parts if n} | {(f"w/x::{w}", w) for _, w in called}
    want = sorted((f, path, w, at) for (f, w), at in called.items() for path, n in functions if n == w)
    assert rows(registry.QUERIES["all_name_join"](spark, str(tmp_path)), "caller", "target", "name", "site") == want
    assert rows(registry.QUERIES["all_reverse_name_join"](spark, str(tmp_path)), "caller", "target") == sorted((f, path) for f, path, _, _ in want)
    n = len(want)
    assert rows(registry.QUERIES["all_edge_union"](spark, str(tmp_path)), "direction", "n_edges", "n_centers") == [("callee", n, len({f for f, *_ in want})), ("caller", n, n)]


def test_rounded_sums_add_in_table_order(spark):
    """The last digits of a sum of doubles, which the order tells, decide how a half rounds."""
    down, up = [520.68, 574.27, 426.6, 215.95], [520.68, 215.95, 426.6, 574.27]
    add = lambda values: functools.reduce(operator.add, values, 0.0)  # noqa: E731  (sum() makes up for lost digits)
    assert sorted(down) == sorted(up) and add(down) < 1737.5 <= add(up)
    values = [("a/x", i, v) for i, v in enumerate(down)] + [("b/x", i, v) for i, v in enumerate(up)] + [("b/y", 9, None), ("c/y", 0, None), ("d/y", 0, -7.25)]
    rows = spark.createDataFrame(values[::-1], "path string, i int, v double").repartition(7)
    low = math.floor(add(down) + 0.5)
    got = {r["folder"]: (r["n"], r["measure"]) for r in hierarchy.rollup_rounded(rows, "path", "v", ["i"], F.count("*").alias("n")).collect()}
    assert got == {"": (11, round(add(down + up) - 7.25)), "a": (4, low), "b": (5, low + 1), "c": (1, None), "d": (1, -7)}
    exact = {r["folder"]: r["measure"] for r in hierarchy.rollup_rounded(rows, "path", "v", ["i"], most=2).collect()}
    assert exact == {"": got[""][1], "a": low + 1, "b": low + 1, "c": None, "d": -7}


def test_measure_rollup_of_any_plan(spark, sf, tmp_path):
    """Orders fifty times over: half the sums end in a half; joins that shuffle must not change how it rounds."""
    shifts = {"orders": {"o_orderkey": 10**7, "o_custkey": 10**6}, "customer": {"c_custkey": 10**6}, "nation": {}, "region": {}}
    con = duckdb.connect()
    for name, keys in shifts.items():
        t = pq.read_table(f"{sf}/{name}.parquet")
        copies = [t]
        for i in range(1, 50 if keys else 1):
            more = t
            for key, by in keys.items():
                at = t.column_names.index(key)
                more = more.set_column(at, key, pc.add(t[key], i * by))
            copies.append(more)
        pq.write_table(pa.concat_tables(copies), tmp_path / f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.sql(registry.ORACLES["measure_rollup"]).fetchall())
    plan = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plan}
    try:
        for k, v in plan.items():
            spark.conf.set(k, v)
        got = registry.QUERIES["measure_rollup"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == want


def test_sums_in_order_of_ranges(spark):
    """Ranges that answer apart give the last digit of adding one by one: halves, signs, powers of two crossed."""
    r = np.random.default_rng(7)
    values = {
        "prices": np.round(r.uniform(0, 5e5, 700), 2),
        "signs": r.normal(0, 1, 300),
        "halves up": np.concatenate([[2.0**53 + 2], r.integers(1, 64, 300) / 2.0]),
        "halves": np.concatenate([[-(2.0**52) * 1.5], r.integers(-64, 64, 300) / 4.0]),
        "near halves": np.concatenate([[2.0**53 + 2], np.tile([-0.49999999999999994, 0.5, -1e-300, 5e-324, 1.5], 40)]),
        "sizes": 10.0 ** r.uniform(-300, 300, 200) * r.choice([-1, 1], 200),
        None: np.round(r.uniform(0, 9, 100), 1),
        "one": np.array([0.1]),
    }
    rows = spark.createDataFrame([(k, f"f{i // 150}", i % 150, float(v)) for k, vs in values.items() for i, v in enumerate(vs)] + [("one", "f9", 1, None)], "k string, file string, i long, v double")
    got = {r["k"]: r["total"] for r in ordered.sum_in_order(rows.repartition(5), "k", ["file", "i"], "v", size=16).collect()}
    assert got == {k: functools.reduce(operator.add, map(float, vs), 0.0) for k, vs in values.items()}


def _as_its_sql(spark, at, tables):
    """measure_rollup's rows over the tables, and those of its SQL, added by one thread."""
    con = duckdb.connect(config={"threads": 1})
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), at / f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    got = registry.QUERIES["measure_rollup"](spark, str(at)).collect()
    return sorted((tuple(r) for r in got), key=repr), sorted(con.sql(registry.ORACLES["measure_rollup"]).fetchall(), key=repr)


def test_measure_rollup_of_large_folders(spark, tmp_path):
    """Folders of more orders than a task adds up at once keep the table's order too."""
    n, seed, low = 140_000, 0, False
    while not low:  # exactly a half, and less of it where the values are added in order
        cents = np.random.default_rng(seed).integers(10**5, 5 * 10**7, n)
        cents[-1] += (50 - int(cents.sum())) % 100
        low = functools.reduce(operator.add, (cents / 100).tolist(), 0.0) < int(cents.sum()) / 100
        seed += 1
    got, want = _as_its_sql(spark, tmp_path, {
        "orders": {"o_orderkey": range(n), "o_custkey": [0] * n, "o_totalprice": cents / 100},
        "customer": {"c_custkey": [0], "c_name": ["c"], "c_nationkey": [0]},
        "nation": {"n_nationkey": [0], "n_name": ["N"], "n_regionkey": [0]},
        "region": {"r_regionkey": [0], "r_name": ["R"]},
    })
    assert got == want == [(f, n, int(cents.sum()) // 100) for f in ("", "R", "R/N", "R/N/c")]


def test_measure_rollup_of_odd_names(spark, tmp_path):
    """Every order counts in each of its folders: those without a key, and where names are null or hold a slash."""
    got, want = _as_its_sql(spark, tmp_path, {
        "orders": {"o_orderkey": [1, None, 2, 3, 4, None], "o_custkey": [0, 0, 1, 2, 3, 4], "o_totalprice": [10.25, 20.5, None, 7.0, 3.5, 0.5]},
        "customer": {"c_custkey": [0, 1, 2, 3, 4], "c_name": ["a/b", "none", None, "d", ""], "c_nationkey": [0, 0, 0, 1, 0]},
        "nation": {"n_nationkey": [0, 1], "n_name": ["M/O", None], "n_regionkey": [0, 0]},
        "region": {"r_regionkey": [0], "r_name": ["S"]},
    })
    assert got == want
    assert ("S/M/O/a/b", 2, 31) in got and (None, 3, 14) in got
