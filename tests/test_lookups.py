"""Intervals, the call index and the grid against brute force, on small and odd tables."""

import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeatlas.operators import call_index, calls, grid, intervals, name_index, nested, view

# -- intervals ------------------------------------------------------------------------------


@given(st.lists(st.integers(-5, 5), max_size=40), st.lists(st.tuples(st.integers(0, 45), st.integers(-6, 6)), max_size=30))
@settings(max_examples=150, deadline=None)
def test_last_above(ends, asked):
    got = intervals.last_above(np.array(ends, np.int64), np.array([c for c, _ in asked], np.int64), np.array([x for _, x in asked], np.int64))
    assert got.tolist() == [max((i for i in range(min(c, len(ends))) if ends[i] > x), default=-1) for c, x in asked]


def some_intervals(seed, nested):
    rng = random.Random(seed)
    out = []
    for key in ("a", "b", "ç"):
        if nested:

            def fill(a, b, depth, key=key):
                while a < b and depth < 7 and rng.random() < 0.9:
                    x = rng.randint(a, b)
                    y = rng.randint(x, b)
                    out.append((key, f"i{len(out)}", x, y))
                    fill(x, y, depth + 1)
                    a = y

            fill(0, 60, 0)
        else:
            out += [(key, f"i{i}", x, x + rng.randint(0, 25)) for i in range(40) for x in [rng.randint(0, 60)]]
    return out


@pytest.mark.parametrize("seed,nested,parts", [(1, True, "1"), (2, True, "9"), (3, False, "9"), (4, False, "4")])
def test_innermost(spark, seed, nested, parts):
    """Files cut over several ranges get the same answers."""
    rng = random.Random(seed)
    iv = some_intervals(seed, nested)
    pts = [(k, f"p{i}", rng.choice([rng.randint(-3, 70), None]) if i % 15 == 0 else rng.randint(-3, 70)) for i, k in enumerate(rng.choices(["a", "b", "ç", "none", None], k=200))]
    inside = lambda k, at: max(((a, -b, i) for key, i, a, b in iv if key == k and at is not None and a <= at < b), default=None)
    want = sorted(((k, p, at, *((m[2], m[0], -m[1]) if (m := inside(k, at)) else (None, None, None))) for k, p, at in pts), key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = spark.createDataFrame(iv + [("a", "x", None, 3), (None, "y", 0, 9)], "key string, id string, start long, end long")
        p = spark.createDataFrame(pts + pts[:2], "key string, id string, at long")
        got = sorted((tuple(r) for r in intervals.innermost(p, d).collect()), key=repr)
        assert got == sorted(want + [w for q in pts[:2] for w in want if (w[0], w[1]) == q[:2]], key=repr)
        order = {key: sorted((x for x in iv if x[0] == key), key=lambda x: (x[2], -x[3], x[1])) for key in ("a", "b", "ç")}
        up = {}
        for key, rows in order.items():
            for n, x in enumerate(rows):
                up[key, x[1]] = next((y[1] for y in reversed(rows[:n]) if y[3] >= x[3]), None)
        assert {(r["key"], r["id"]): r["parent"] for r in intervals.parents(d).collect()} == up
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_grow_with_the_events(spark, monkeypatch):
    """What one Python task sorts at once has a bound, whatever the number of shuffle partitions."""
    sizes = []
    whole = intervals.saved

    def seen(df):
        made = whole(df)
        sizes.extend(r["count"] for r in made.groupBy("_range").count().collect())
        return made

    monkeypatch.setattr(intervals, "RANGE", 50, raising=False)
    monkeypatch.setattr(intervals, "saved", seen)
    rows = spark.range(1000).selectExpr("id % 3 as key", "id as id", "id as start", "id + 2 as end")
    assert intervals.parents(rows).count() == 1000
    assert max(sizes) <= 150 and sum(sizes) == 1000


def test_innermost_of_nothing(spark):
    p = spark.createDataFrame([("a", "p", 1)], "key string, id string, at long")
    none = spark.createDataFrame([], "key string, id string, start long, end long")
    assert [tuple(r) for r in intervals.innermost(p, none).collect()] == [("a", "p", 1, None, None, None)]
    assert intervals.innermost(p.limit(0), none).collect() == [] and intervals.parents(none).collect() == []
    named = spark.createDataFrame([(7, 1, 0, 5)], "doc long, _id long, _pos long, _end long")
    at = spark.createDataFrame([(7, 2, 3)], "doc long, _id long, at long")
    assert intervals.innermost(at, named, "doc", "at", "_id", "_pos", "_end").first()["inner"] == 1


# -- the call index -------------------------------------------------------------------------


def call_tables(spark):
    rng = random.Random(7)
    names = ["run", "load", "A::new", "save", "go", "x"]
    rows = [(f"f{i}.py::C{i % 3}::{names[i % 6].split('::')[-1]}", rng.choice(names), j, rng.choice([None, "v"])) for i in range(40) for j in range(6)]
    c = calls.distinct_calls(spark.createDataFrame(rows, "caller string, name string, site long, receiver string"))
    f = spark.createDataFrame(sorted({(r[0], r[0].split("::")[-1]) for r in rows} | {("g.rs::A::new", "new"), ("h.rs::new", "new")}), "path string, name string")
    b = spark.createDataFrame([("f0.py::C0::run", "v", "C1")], "caller string, receiver string, class string")
    return c, f, b


def test_call_index(spark):
    c, f, b = call_tables(spark)
    index = call_index.build(c, f, b, 16)
    try:
        want = {}
        for r in calls.edges(c, f, b).collect():
            want.setdefault(r["center"], []).append(tuple(r))
        named = {r["path"]: r["name"] for r in f.collect()}
        for center in ["f0.py::C0::run", "f3.py::C0::save", "g.rs::A::new"]:
            got = sorted((tuple(r) for r in call_index.lookup(index, {center: named[center]}).collect()), key=repr)
            assert got == sorted(want.get(center, []), key=repr) and got
        two = dict(list(named.items())[:2])
        assert call_index.lookup(index, two).count() == sum(len(want.get(k, [])) for k in two)
        assert call_index.lookup(index, {"nowhere::x": "nothing"}).collect() == []
    finally:
        index.drop()


def test_call_index_reads_its_buckets_only(spark):
    c, f, _ = call_tables(spark)
    index = call_index.build(c, f, buckets=16)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(auto)
    spark.conf.set(auto, "false")  # else plans don't say what they prune
    try:
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        back = plan(call_index.callers(index, {"h.rs::new": "new"}))
        assert re.findall(r"SelectedBucketsCount: (\d+) out of 16", back) == ["1"]
        out = re.findall(r"SelectedBucketsCount: (\d+) out of 16", plan(call_index.callees(index, ["f0.py::C0::run"])))
        assert len(out) == 2 and min(map(int, out)) == 1 and max(map(int, out)) <= 6
    finally:
        spark.conf.set(auto, before)
        index.drop()


# -- the grid -------------------------------------------------------------------------------


def rects_of(seed, n):
    """Sides over six decades, in three depths, some touching and some equal."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        side = 10.0 ** rng.randint(-3, 3)
        x, y = rng.choice([round(rng.uniform(-50, 50), 2), float(rng.randint(-5, 5))]), rng.choice([round(rng.uniform(-50, 50), 2), 0.0])
        out.append((i, rng.randint(0, 2), x, y, side * rng.choice([1, 0.5, 3, 0]), side * rng.choice([1, 2, 0.25]), i))
    return out


_RECTS = "id long, depth int, x double, y double, w double, h double, pre long"


def test_hit_tests(spark):
    rng = random.Random(2)
    rows = rects_of(1, 250)
    pts = [(i, round(rng.uniform(-60, 60), 2), round(rng.uniform(-60, 60), 2)) for i in range(300)]
    pts += [(300 + i, r[2] + dx * r[4], r[3] + dy * r[5]) for i, (r, dx, dy) in enumerate((r, *rng.choice([(0, 0), (1, 1), (0.5, 0.5)])) for r in rows)] + [(-1, None, 2.0)]
    got = {r["point"]: r["id"] for r in grid.hit_tests(spark.createDataFrame(pts, "point long, px double, py double"), spark.createDataFrame(rows, _RECTS)).collect()}
    assert got == {p: max((i for i, _, x, y, w, h, _ in rows if px is not None and x <= px < x + w and y <= py < y + h), default=None) for p, px, py in pts}
    none = spark.createDataFrame([], _RECTS)
    assert [tuple(r) for r in grid.hit_tests(spark.createDataFrame(pts[:1], "point long, px double, py double"), none).collect()] == [(0, None)]


@pytest.mark.parametrize("direction", ["left", "right", "up", "down"])
def test_neighbours(spark, direction):
    rows = rects_of(3, 220)
    d = spark.createDataFrame(rows, _RECTS)
    got = {r["id"]: r["neighbour"] for r in grid.neighbours(d, direction).collect()}
    across, want = direction in ("left", "right"), {}
    for i, depth, x, y, w, h, _ in rows:
        a, s = (y, h) if across else (x, w)
        best = []
        for j, dj, x2, y2, w2, h2, _ in rows:
            b, t = (y2, h2) if across else (x2, w2)
            gap = {"right": x2 - (x + w), "left": x - (x2 + w2), "down": y2 - (y + h), "up": y - (y2 + h2)}[direction]
            if j != i and dj == depth and b < a + s and b + t > a and gap >= 0:
                best.append((gap, abs(b + t / 2 - (a + s / 2)), j))
        if best:
            want[i] = min(best)[2]
    assert got == want and len(want) > 50
    assert grid.neighbours(d.limit(0), direction).collect() == []


def test_same_as_bands(spark):
    rows = [(i, i % 2, float(i % 9) * 10, float(i // 9) * 8, 8.0, 7.0, i) for i in range(90)]
    d = spark.createDataFrame(rows, _RECTS)
    assert {tuple(r) for r in grid.neighbours(d, "right").collect()} == {tuple(r) for r in view.nearest(d, "right", 15.0).collect()}


def joins_of(df, how):
    """Joins of a plan, before anything has run, that broadcast a side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\b(?:BroadcastHashJoin|BroadcastNestedLoopJoin)[^\n]*\b" + how, plan)


def test_exploded_rectangles_are_not_broadcast(spark):
    """A few bytes of a file may be millions of cells: only the levels that occur are broadcast."""
    r = spark.createDataFrame([(i, 0, float(i), 1.0, 2.0, 3.0, i) for i in range(9)], "id long, depth int, x double, y double, w double, h double, pre long")
    points = spark.createDataFrame([(1, 1.0, 2.0)], "point long, px double, py double")
    for made in (grid.neighbours(r, "down"), view.nearest(r, "right", 2.0)):
        assert not joins_of(made, "Inner")
    assert not joins_of(grid.hit_tests(points, r), "(?:Inner|LeftOuter)")


def test_levels(spark):
    sides = [0.0, 1e-9, 0.5, 1.0, 1.0000001, 2.0, 3.0, 1024.0, 1025.0, 1e12]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sides], "s double").select(grid.level_of(F.col("s"))).collect()]
    assert all(2.0**lv >= s and (s <= 2.0**-60 or 2.0 ** (lv - 1) < s) for s, lv in zip(sides, got, strict=True))


# -- names by length ------------------------------------------------------------------------


def test_name_index(spark):
    """The results of the search over all names, whatever the query."""
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdeÄäßİ日._ ") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["x" * 400, "y" * 300 + "a", "abc", "abc", None]
    d = spark.createDataFrame(list(enumerate(names)), "pre long, name string")
    index = name_index.build(d)
    try:
        for q in ["", "a", "AB", "ä", "ÄB", "日", "ab.", "zzz", "ya", "._", "e a"]:
            want = [(r["name"], r["pre"]) for r in view.search(d.where("name is not null"), q).select("name", "pre").collect()]
            assert [tuple(r) for r in name_index.search(index, q).collect()] == want, q
    finally:
        index.drop()
    empty = name_index.build(d.limit(0))
    assert name_index.search(empty, "a").collect() == []


def test_name_index_reads_few_lengths(spark, monkeypatch):
    d = spark.range(3000).select(F.col("id").alias("pre"), F.repeat(F.lit("ab"), (F.col("id") % 90 + 1).cast("int")).alias("name"))
    index, read = name_index.build(d), []
    names = name_index.NameIndex.names
    monkeypatch.setattr(name_index.NameIndex, "names", lambda self, lengths: read.extend(lengths) or names(self, lengths))
    try:
        assert len(name_index.search(index, "abab").collect()) == 12
        assert len(index.lengths) == 90 and read == [4]
        plan = names(index, [4])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(length" in plan
    finally:
        index.drop()


# -- nested JSON ----------------------------------------------------------------------------


def test_nested(spark, tmp_path):
    """What is written is JSON for any reader, nests as the tree does, and reads back equal."""
    rng = random.Random(2)
    rows, pre = [], [0]

    def grow(parent, depth, anc):
        me = f'{"n\"é,]}" if rng.random() < 0.2 else "n"}{pre[0]}'
        rows.append((me, parent, depth, anc, pre[0], rng.choice([None, 3])))
        pre[0] += 1
        for _ in range(rng.randint(0, 4) if depth < 30 and len(rows) < 120 else 0):
            grow(me, depth + 1, [*anc, me])

    while len(rows) < 60:
        rows.clear()
        pre[0] = 0
        grow(None, 0, [])
    d = spark.createDataFrame(rows, "id string, parent_id string, depth int, anc array<string>, pre long, measure long")
    folder = f"file://{tmp_path}/tree"
    nested.write(d.repartition(3), folder)
    back = nested.read(spark, folder, "id string, depth int, pre long, measure long")
    assert {tuple(r) for r in back.select("id", "parent_id", "depth", "pre", "measure").collect()} == {(r[0], r[1], r[2], r[4], r[5]) for r in rows}
    texts = {}
    for r in sorted(nested.documents(spark, folder).collect(), key=lambda r: (r["top"] or "", r["part"].rsplit("/", 1)[-1])):
        texts[r["top"]] = texts.get(r["top"], "") + r["text"]
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r[0])

    def same(node):
        assert [c["id"] for c in node["children"]] == kids.get(node["id"], [])
        return 1 + sum(map(same, node["children"]))

    tops = [json.loads(t) for top, t in texts.items() if json.loads(t)["depth"] == 1]
    assert sum(map(same, tops)) == len(rows) - 1 and {t["id"] for t in tops} == set(kids[rows[0][0]])
