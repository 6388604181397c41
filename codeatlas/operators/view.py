"""Queries over rectangles: what a viewport shows, what is under a point, what is next to a node,
and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.geometry import container_rung, leaf_draw, project
from codeatlas.functions.paths import fuzzy_match
from codeatlas.functions.tables import SEARCH_LIMIT


def visible(rects: DataFrame, cam_x: float, cam_y: float, zoom: float, view_w: float, view_h: float) -> DataFrame:
    """Rows of (id, x, y, w, h, leaf) that meet the viewport (touching counts) and aren't merged
    away: px, py, pw, ph clipped to two pixels around it, and the level of detail."""
    c = F.col
    px, py, pw, ph = project(c("x"), c("y"), c("w"), c("h"), cam_x, cam_y, zoom)
    p = rects.select("*", px.alias("px"), py.alias("py"), pw.alias("pw"), ph.alias("ph"))
    p = p.where((c("px") <= view_w) & (c("px") + c("pw") >= 0) & (c("py") <= view_h) & (c("py") + c("ph") >= 0))
    lod = F.when(c("leaf"), leaf_draw(c("ph"), c("pw"), c("h"))).otherwise(container_rung(c("ph"), c("pw")))
    p = p.withColumn("lod", lod).where("lod is not null")
    x0, y0 = F.greatest(c("px"), F.lit(-2.0)), F.greatest(c("py"), F.lit(-2.0))
    return p.select("id", x0.alias("cx"), y0.alias("cy"), (F.least(c("px") + c("pw"), F.lit(view_w + 2.0)) - x0).alias("cw"), (F.least(c("py") + c("ph"), F.lit(view_h + 2.0)) - y0).alias("ch"), "lod")


def hit_test(rects: DataFrame, x: float, y: float, rank: str = "pre") -> DataFrame:
    """The deepest rectangle under a point: the last in preorder."""
    c = F.col
    under = rects.where((c("x") <= x) & (x < c("x") + c("w")) & (c("y") <= y) & (y < c("y") + c("h")))
    return under.agg(F.max_by("id", rank).alias("id"))


_AHEAD = {
    "right": ("y", "h", lambda c, r: r("x") - (c("x") + c("w"))),
    "left": ("y", "h", lambda c, r: c("x") - (r("x") + r("w"))),
    "down": ("x", "w", lambda c, r: r("y") - (c("y") + c("h"))),
    "up": ("x", "w", lambda c, r: c("y") - (r("y") + r("h"))),
}


def nearest(rects: DataFrame, direction: str, cell: float) -> DataFrame:
    """(id, neighbour) of rectangles of one depth: the one ahead of least edge gap that overlaps
    across the direction; ties by misalignment, then id. Bands of height ``cell`` across the
    direction make an equi-join of the range join; a rectangle is in each band that it meets."""
    at, size, gap = _AHEAD[direction]
    bands = lambda d: d.withColumn("band", F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell))))
    a, b = bands(rects).alias("a"), bands(rects).alias("b")
    c, r = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    # exploded rows are many more than a file's size tells: neither side may be broadcast
    j = a.join(b.hint("merge"), (c("band") == r("band")) & (c("depth") == r("depth")) & (c("id") != r("id")))
    j = j.where((r(at) < c(at) + c(size)) & (r(at) + r(size) > c(at)) & (gap(c, r) >= 0))
    mis = F.abs(r(at) + r(size) / 2 - (c(at) + c(size) / 2))
    return j.groupBy(c("id").alias("id")).agg(F.min_by(r("id"), F.struct(gap(c, r), mis, r("id"))).alias("neighbour"))


def search(nodes: DataFrame, query: str, name: str = "name", order: str = "pre", limit: int = SEARCH_LIMIT) -> DataFrame:
    """Names that hold the query's characters in order: shortest first, then by name, then preorder."""
    return nodes.where(fuzzy_match(query, name)).orderBy(F.octet_length(name), name, order).limit(limit)


def interpolate(old: DataFrame, new: DataFrame, p: Column) -> DataFrame:
    """Rectangles between two layouts of the same ids; the new one where the ids differ."""
    o = old.select("id", *(F.col(c).alias(f"o{c}") for c in "xywh"))
    j = o.join(new, "id", "full_outer")
    same = j.agg(F.bool_and(F.col("x").isNotNull() & F.col("ox").isNotNull()).alias("same"))  # one row
    j = j.where("x is not null").crossJoin(F.broadcast(same))
    return j.select("id", *(F.when(F.col("same"), F.col(f"o{c}") + (F.col(c) - F.col(f"o{c}")) * p).otherwise(F.col(c)).alias(c) for c in "xywh"))
