"""Deterministic packing of a tree into rectangles.

Sizes go bottom-up, one Spark job for each depth: siblings are grouped by parent and laid out by
a small Python function, as each placement depends on the one before. Positions go top-down as
sums over exploded ancestors. The tree's depth, not its size, sets the number of jobs.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.tables import PACK_FACTORS, SOURCE_ORDERED
from codeatlas.plans.lineage import saved


@dataclass(frozen=True)
class PackConfig:
    page_w: float = 640.0
    line_step: float = 15.6
    header: float = 20.8
    container_header: float = 20.8
    bottom_pad: float = 6.0
    gap: float = 8.0
    aspect: float = 1.0
    max_display_lines: int | None = None


def leaf_size(measure: Column, cfg: PackConfig) -> Column:
    m = F.least(measure, F.lit(cfg.max_display_lines)) if cfg.max_display_lines is not None else measure
    return F.lit(cfg.header) + (1 + m) * cfg.line_step + cfg.bottom_pad


def _envelope(size: tuple[float, float], aspect: float) -> float:
    w = max(size[0], size[1] * aspect)
    return w * (w / aspect)


def place(sizes: list[tuple[float, float]], gap: float, width: float):
    """Bottom-left skyline: each rectangle where its top is lowest, then lower, then further left.
    Returns positions and the used width and height."""
    begins, tops = [0.0], [0.0]  # the skyline's steps from left to right, each up to the next one's begin
    out, used = [], (0.0, 0.0)
    for w, h in sizes:
        pw, ph = w + gap, h + gap
        best, high, j, n = None, deque(), 0, len(begins)
        for i, x in enumerate(begins):
            if x + pw > width:
                break
            # the steps that the rectangle would stand on, and of these the indices of falling tops
            while j < n and begins[j] < x + pw:
                while high and tops[high[-1]] <= tops[j]:
                    high.pop()
                high.append(j)
                j += 1
            if high[0] < i:
                high.popleft()
            if best is None or tops[high[0]] < best[0]:
                best = tops[high[0]], x, i, j
        y, x, i, j = best
        end = begins[j] if j < n else width
        steps, heights = [x], [y + ph]
        if end > x + pw and tops[j - 1] != y + ph:  # what is left of the last step
            steps.append(x + pw)
            heights.append(tops[j - 1])
        after = tops[j] if j < n else None
        stop = j + 1 if after == heights[-1] else j  # equal neighbours are one step
        if i and tops[i - 1] == y + ph:
            del steps[0], heights[0]
        begins[i:stop], tops[i:stop] = steps, heights
        out.append((x, y))
        used = max(used[0], x + w), max(used[1], y + h)
    return out, used


def skyline(sizes: list[tuple[float, float]], gap: float, aspect: float):
    """The placement of least envelope over the baseline width and its multiples."""
    if len(sizes) <= 1:
        return [(0.0, 0.0)] * len(sizes), sizes[0] if sizes else (0.0, 0.0)
    widest = max(w + gap for w, _ in sizes)
    area = 0.0
    for w, h in sizes:
        area += (w + gap) * (h + gap)
    base = max(widest, math.sqrt(area * aspect))
    tried = dict.fromkeys([base, *(max(widest, base * f) for f in PACK_FACTORS)])
    return min((place(sizes, gap, w) for w in tried), key=lambda r: _envelope(r[1], aspect))


def shelves(sizes: list[tuple[float, float]], gap: float, target: float):
    """Columns filled to a target height, in order."""
    x = y = col = top = 0.0
    out = []
    for w, h in sizes:
        if y > 0.0 and y + h > target:
            x, y, col = x + col + gap, 0.0, 0.0
        out.append((x, y))
        col, top = max(col, w), max(top, y + h)
        y += h + gap
    return out, (x + col, top)


def shelf_pack(sizes: list[tuple[float, float]], gap: float, aspect: float):
    if len(sizes) == 1:
        return shelves(sizes, gap, sizes[0][1])
    area = 0.0
    for w, h in sizes:
        area += w * h
    tallest = max(h for _, h in sizes)
    base = max(tallest, math.sqrt(area / aspect))
    return min((shelves(sizes, gap, t) for t in [base, *(max(tallest, base * f) for f in PACK_FACTORS)]), key=lambda r: _envelope(r[1], aspect))


_RANK = {"struct": 0, "enum": 0, "trait": 0, "interface": 0, "type": 0, "fn": 1, "class": 2, "impl": 2, "module": 3, "namespace": 3}


def arrange(children: pd.DataFrame, kind: str, path: str, cfg: PackConfig):
    """Relative (x, y) of the children and the parent's size. Children have kind, label, name,
    ordinal, role (number), byte_start, w, h."""
    rows = children.to_dict("records")
    gap, head = cfg.gap, cfg.container_header + cfg.gap
    key_name = lambda r: r["name"].encode()
    if kind == "folder":
        rows.sort(key=lambda r: (r["role"], -r["h"], key_name(r), r["ordinal"]))
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(r["role"], []).append(r)
        laid = [(g, *skyline([(r["w"], r["h"]) for r in g], gap, cfg.aspect)) for _, g in sorted(groups.items())]
        blocks, bounds = skyline([b for _, _, b in laid], gap, cfg.aspect)
        at = [(r, bx + x, by + y) for (g, pos, _), (bx, by) in zip(laid, blocks, strict=True) for r, (x, y) in zip(g, pos, strict=True)]
    else:
        file = path.split("::")[0].split("#")[0]
        ext = file.rsplit(".", 1)[1] if "." in file else ""
        if rows[0]["kind"] == "chunk" or ext in SOURCE_ORDERED:
            rows.sort(key=lambda r: (r["byte_start"] if r["byte_start"] == r["byte_start"] and r["byte_start"] is not None else 0, r["ordinal"]))
        else:
            rows.sort(key=lambda r: (_RANK.get(r["label"], 4) if r["kind"] == "item" else 0, -r["h"], key_name(r), r["ordinal"]))
        pos, bounds = shelf_pack([(r["w"], r["h"]) for r in rows], gap, cfg.aspect)
        at = [(r, x, y) for r, (x, y) in zip(rows, pos, strict=True)]
    return [(r["id"], gap + x, head + y) for r, x, y in at], (bounds[0] + 2 * gap, cfg.container_header + bounds[1] + 2 * gap)


def pack(nodes: DataFrame, cfg: PackConfig = PackConfig(), max_depth: int | None = None, save=saved) -> DataFrame:
    """(id, x, y, w, h) of every node. ``nodes`` has id, parent_id (null at the root), kind, label,
    path, name, ordinal, role (number), byte_start, measure, depth, and anc: the ids from the
    root to the parent. ``save`` keeps each level's result and cuts its lineage."""
    nodes = save(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0] if max_depth is None else max_depth
    size = pages(nodes, cfg)
    place_of = None
    for depth in range(deepest, 0, -1):
        kids = nodes.where(F.col("depth") == depth).select("id", "parent_id", "kind", "label", "name", "ordinal", "role", "byte_start").join(size, "id")
        kids = kids.join(nodes.select(F.col("id").alias("parent_id"), F.col("kind").alias("pkind"), F.col("path").alias("ppath")), "parent_id")

        def lay(g: pd.DataFrame) -> pd.DataFrame:
            pos, (w, h) = arrange(g.sort_values(["name", "ordinal", "id"]), g["pkind"].iloc[0], g["ppath"].iloc[0], cfg)
            return pd.DataFrame([(g["parent_id"].iloc[0], i, x, y, w, h) for i, x, y in pos], columns=["parent", "id", "dx", "dy", "w", "h"])

        level = save(kids.groupBy("parent_id").applyInPandas(lay, "parent string, id string, dx double, dy double, w double, h double"))
        place_of = level.select("id", "dx", "dy") if place_of is None else place_of.unionByName(level.select("id", "dx", "dy"))
        size = size.unionByName(level.select(F.col("parent").alias("id"), "w", "h").distinct())
    if place_of is None:
        return size.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "w", "h")
    return absolute(nodes, size, place_of)


def milestones(total: Column, snapshots: int) -> Column:
    """Distinct ceil(k total / (s - 1)) for k below s = min(max(snapshots, 2), total + 1)."""
    s = F.least(F.greatest(F.lit(snapshots), F.lit(2)).cast("long"), total + 1)
    steps = F.transform(F.sequence(F.lit(0).cast("long"), s - 1), lambda k: F.floor((k * total + s - 2) / (s - 1)).cast("long"))
    return F.array_distinct(steps)


def pages(nodes: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """(id, w, h) of nodes without children."""
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return nodes.join(parents, "id", "left_anti").select("id", F.lit(cfg.page_w).alias("w"), leaf_size(F.col("measure"), cfg).alias("h"))


def draft_layouts(nodes: DataFrame, cfg: PackConfig = PackConfig(), exact: DataFrame | None = None, max_depth: int | None = None, save=saved) -> tuple[DataFrame, DataFrame]:
    """(id, w, h) of every node and (id, dx, dy) of every child in its parent: containers are
    vertical stacks in the order of ``pre``. Where ``exact`` has a container's layout (id, w, h,
    children: array of id, dx, dy) it holds instead. One job for each depth, running sums by parent."""
    from pyspark.sql import Window

    nodes = save(nodes.select("id", "parent_id", "measure", "depth", "pre"))
    deepest = nodes.agg(F.max("depth")).first()[0] if max_depth is None else max_depth
    size, place_of = pages(nodes, cfg), None
    above = Window.partitionBy("parent_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(deepest or 0, 0, -1):
        kids = nodes.where(F.col("depth") == depth).join(size, "id")
        if exact is not None:
            kids = kids.join(exact.select(F.col("id").alias("parent_id"), F.col("w").alias("pw"), F.col("h").alias("ph")), "parent_id", "left")
            kids = kids.join(exact.select(F.explode("children").alias("c")).select("c.id", F.col("c.dx").alias("ex"), F.col("c.dy").alias("ey")), "id", "left")
        else:
            kids = kids.withColumns({c: F.lit(None).cast("double") for c in ("pw", "ph", "ex", "ey")})
        stacked = cfg.container_header + cfg.gap + F.coalesce(F.sum(F.col("h") + cfg.gap).over(above), F.lit(0.0))
        level = save(kids.select("id", "parent_id", "w", "h", "pw", "ph", F.coalesce("ex", F.lit(cfg.gap)).alias("dx"), F.coalesce("ey", stacked).alias("dy")))
        place_of = level.select("id", "dx", "dy") if place_of is None else place_of.unionByName(level.select("id", "dx", "dy"))
        up = level.groupBy(F.col("parent_id").alias("id")).agg(F.max("pw").alias("pw"), F.max("ph").alias("ph"), (F.max("w") + 2 * cfg.gap).alias("sw"), (cfg.container_header + cfg.gap + F.sum(F.col("h") + cfg.gap)).alias("sh"))
        size = size.unionByName(up.select("id", F.coalesce("pw", "sw").alias("w"), F.coalesce("ph", "sh").alias("h")))
    return size, place_of if place_of is not None else size.select("id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")).limit(0)


def absolute(nodes: DataFrame, size: DataFrame, place_of: DataFrame) -> DataFrame:
    """(id, x, y, w, h): offsets of self and ancestors (``anc``), added from the root down."""
    up = nodes.select("id", F.posexplode(F.concat("anc", F.array("id"))).alias("d", "a"))
    up = up.join(place_of.select(F.col("id").alias("a"), "dx", "dy"), "a", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy")))).alias("s"))
    total = lambda c: F.aggregate("s", F.lit(0.0), lambda acc, v: acc + v[c])
    return up.select("id", total("dx").alias("x"), total("dy").alias("y")).join(size, "id")


def draft(nodes: DataFrame, cfg: PackConfig = PackConfig(), max_depth: int | None = None, save=saved) -> DataFrame:
    """Rectangles of the draft layout of the whole tree."""
    return absolute(nodes, *draft_layouts(nodes, cfg, None, max_depth, save))


def postorder(nodes: DataFrame) -> DataFrame:
    """(id, post, inherited) of nodes with ``pre``, ``anc``, ``kind`` and ``own_role`` (null where a
    node's name says nothing strong): children before parents, siblings in order, and the role that
    each inherits: from folders the nearest one that says so at or above it, Source below files.

    A node's place is its place in preorder, less its ancestors, plus what lies below it."""
    below = nodes.select(F.explode("anc").alias("id")).groupBy("id").agg(F.count("*").alias("below"))
    up = nodes.select("id", F.posexplode(F.concat("anc", F.array("id"))).alias("d", "a")).join(nodes.select(F.col("id").alias("a"), "kind", "own_role"), "a")
    chain = up.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "kind", "own_role"))).alias("c"))

    def step(acc: Column, n: Column) -> Column:  # the role that a node takes from its parent and itself
        role = F.when(n["d"] == 0, F.lit("Source")).when(acc["kind"] == "folder", F.coalesce(n["own_role"], acc["role"])).otherwise("Source")
        return F.struct(role.alias("role"), n["kind"].alias("kind"))

    role = F.aggregate("c", F.struct(F.lit("Source").alias("role"), F.lit("folder").alias("kind")), step)["role"]
    j = nodes.join(below, "id", "left").join(chain.select("id", role.alias("inherited")), "id")
    return j.select("id", (F.col("pre") - F.size("anc") + F.coalesce("below", F.lit(0))).cast("long").alias("post"), "inherited")


def progressive(nodes: DataFrame, post: DataFrame, snapshots: int, cfg: PackConfig = PackConfig(), max_depth: int | None = None, save=saved) -> DataFrame:
    """(completed, id, x, y, w, h): the draft layout at 0, the whole packing at the last step, and
    at the milestones between them the packing of what is done with the draft of what is not.
    ``post`` is the order of work. A step between shows at the first container done from its
    milestone on, as a page changes nothing.

    Draft and packing are made once. What is done at a step is a beginning of the postorder, so the only
    containers that differ from both are those with some of their nodes done: one path from the root.
    Their sizes are sums over their children, for all steps in one job; every other node keeps its place
    within the topmost container that is wholly done or wholly drafted, and moves with that. So a step
    costs its path and the rows that it returns, not a layout."""
    from pyspark.sql import Window

    spark, nodes, post = nodes.sparkSession, save(nodes), save(post.select("id", "post"))
    whole = save(pack(nodes, cfg, max_depth, save))
    drafted = save(draft(nodes, cfg, max_depth, save))
    total = post.count()
    ends = drafted.withColumn("completed", F.lit(0).cast("long")).unionByName(whole.withColumn("completed", F.lit(total).cast("long")))
    s = min(max(snapshots, 2), total + 1)
    marks = sorted({-(-k * total // (s - 1)) for k in range(1, s - 1)} - {0, total})
    held = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    # the first container at or after each milestone, if it comes before the end: one row
    at = F.col("post") + 1
    first = post.join(held, "id").agg(*(F.min(F.when(at >= m, at)) for m in marks)).first() if marks else ()
    steps = sorted({int(x) for x in first if x is not None and x < total})
    if not steps:
        return ends.select("completed", "id", "x", "y", "w", "h")

    below = nodes.select(F.explode("anc").alias("id")).groupBy("id").agg(F.count("*").alias("below"))
    tree = nodes.select("id", "parent_id", "depth", "pre").join(post, "id").join(below, "id", "left").withColumn("low", F.col("post") - F.coalesce("below", F.lit(0)))
    begun = F.filter(F.array(*(F.lit(x).cast("long") for x in steps)), lambda x: (F.col("low") < x) & (x <= F.col("post")))  # some of its nodes are done, itself is not
    tree = save(tree.withColumn("begun", begun))
    size = tree.join(whole.select("id", F.col("w").alias("ew"), F.col("h").alias("eh")), "id").join(drafted.select("id", F.col("w").alias("fw"), F.col("h").alias("fh")), "id")
    path = tree.select(F.col("id").alias("parent_id"), F.explode("begun").alias("step"))
    kids = size.join(path, "parent_id").withColumn("done", F.col("post") < F.col("step")).withColumn("open", F.array_contains("begun", F.col("step")))
    kids = save(kids.select("step", "parent_id", "id", "depth", "pre", "done", "open", F.when(F.col("done"), F.col("ew")).otherwise(F.col("fw")).alias("w"), F.when(F.col("done"), F.col("eh")).otherwise(F.col("fh")).alias("h")))
    # a row for each step and depth: what a begun container's other children take, from the deepest up
    rest = kids.where(~F.col("open"))
    took = rest.groupBy("step", "parent_id").agg(F.max("w").alias("w"), F.sum(F.col("h") + cfg.gap).alias("h"))
    chain = path.join(tree.select(F.col("id").alias("parent_id"), "depth"), "parent_id").join(took, ["step", "parent_id"], "left").collect()
    made, inner = [], {}
    for r in sorted(chain, key=lambda r: -r["depth"]):
        w, h = inner.get(r["step"], (0.0, -cfg.gap))
        w, h = max(w, r["w"] or 0.0) + 2 * cfg.gap, cfg.container_header + cfg.gap + (r["h"] or 0.0) + h + cfg.gap
        inner[r["step"]] = w, h
        made.append((r["step"], r["parent_id"], r["depth"], w, h))
    sizes = spark.createDataFrame([(a, i, w, h) for a, i, _, w, h in made], "step long, id string, nw double, nh double")
    known = kids.join(F.broadcast(sizes), ["step", "id"], "left").withColumn("h", F.coalesce("nh", "h"))
    above = Window.partitionBy("step", "parent_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    known = save(known.withColumn("dy", cfg.container_header + cfg.gap + F.coalesce(F.sum(F.col("h") + cfg.gap).over(above), F.lit(0.0))))
    # where the begun containers lie, from the root down
    inside = {(r["step"], r["id"]): (r["parent_id"], r["dy"]) for r in known.where("open").collect()}
    corner: dict[tuple[int, str], tuple[float, float]] = {}
    for a, i, _, _, _ in sorted(made, key=lambda m: m[2]):
        up = inside.get((a, i))
        x, y = corner[a, up[0]] if up else (0.0, 0.0)
        corner[a, i] = (x + cfg.gap, y + up[1]) if up else (0.0, 0.0)
    corners = spark.createDataFrame([(a, i, *corner[a, i]) for a, i, *_ in made], "step long, parent_id string, px double, py double")
    at_top = tree.where("parent_id is null").withColumn("step", F.explode(F.array(*(F.lit(x).cast("long") for x in steps)))).where(~F.array_contains("begun", F.col("step")))
    tops = at_top.select("step", "id", (F.col("post") < F.col("step")).alias("done"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"))
    moved = known.where(~F.col("open")).join(F.broadcast(corners), ["step", "parent_id"]).select("step", "id", "done", (F.col("px") + cfg.gap).alias("ax"), (F.col("py") + F.col("dy")).alias("ay")).unionByName(tops)
    both = whole.select("id", *(F.col(c).alias(f"e{c}") for c in "xywh")).join(drafted.select("id", *(F.col(c).alias(f"f{c}") for c in "xywh")), "id")
    pick = lambda c: F.when(F.col("done"), F.col(f"e{c}")).otherwise(F.col(f"f{c}"))
    moved = moved.join(both, "id").select("step", "done", F.col("id").alias("a"), (F.col("ax") - pick("x")).alias("mx"), (F.col("ay") - pick("y")).alias("my"))
    # each node moves with the one of its ancestors (or itself) that lies in a begun container
    near = nodes.select("id", F.explode(F.concat("anc", F.array("id"))).alias("a")).join(moved, "a").join(both, "id")
    kept = near.select("id", (pick("x") + F.col("mx")).alias("x"), (pick("y") + F.col("my")).alias("y"), pick("w").alias("w"), pick("h").alias("h"), F.col("step").alias("completed"))
    opened = spark.createDataFrame([(i, *corner[a, i], w, h, a) for a, i, _, w, h in made], "id string, x double, y double, w double, h double, completed long")
    return ends.unionByName(kept).unionByName(opened).select("completed", "id", "x", "y", "w", "h")
