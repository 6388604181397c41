"""Rectangles of any sizes in a hierarchical grid.

A rectangle's level is the least power of two that its longer side fits in, so it lies in at most four
cells of that level whatever its size. A point lies in one cell of each level that occurs: hit tests of a
whole table of points are one equi-join on (level, cell), with the exact test on top.

For neighbours the grid has one axis, across the direction. Of two rectangles that overlap there, the
longer one is in at most two cells of its level, and the shorter one is put into the cells of every level
above its own: again an equi-join, with no band width to choose and no rectangle in all bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.view import _AHEAD


def level_of(side: Column) -> Column:
    """The least power of two that is no less than a side, as its exponent; the lowest for empty ones."""
    rough = F.ceil(F.log2(F.greatest(side, F.lit(2.0**-60)))).cast("int")
    # the logarithm may be off by one unit in the last place
    return F.when(F.pow(F.lit(2.0), rough) < side, rough + 1).when(F.pow(F.lit(2.0), rough - 1) >= F.greatest(side, F.lit(2.0**-60)), rough - 1).otherwise(rough)


def cell_of(at: Column, level: Column) -> Column:
    """The number of the level's cell that holds a coordinate. As double: whole and exact for any size."""
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("double") + F.lit(0.0)


def cells(rects: DataFrame) -> DataFrame:
    """Each rectangle (x, y, w, h) once for each cell of its level that it meets: _level, _cx, _cy."""
    lv = rects.withColumn("_level", level_of(F.greatest("w", "h")))
    span = lambda a, s: F.array_distinct(F.array(cell_of(F.col(a), F.col("_level")), cell_of(F.col(a) + F.col(s), F.col("_level"))))
    return lv.withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h")))


def hit_tests(points: DataFrame, rects: DataFrame, rank: str = "pre") -> DataFrame:
    """(point, id): for each point (point, px, py) the deepest rectangle (id, x, y, w, h, rank) under it,
    the last by rank; null where there is none. Left and top edges count, right and bottom ones don't.
    Points and rectangles with a null coordinate meet nothing; empty rectangles neither."""
    there = cells(rects.where("w > 0 and h > 0 and x is not null and y is not null"))
    levels = sorted(r[0] for r in there.select("_level").distinct().collect())  # one row a level: exponents of doubles
    at = points.select("point", "px", "py", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("_level"))
    at = at.withColumns({"_cx": cell_of(F.col("px"), F.col("_level")), "_cy": cell_of(F.col("py"), F.col("_level"))})
    # exploded rows are many more than a file's size tells: neither side may be broadcast
    j = at.join(there.hint("merge"), ["_level", "_cx", "_cy"]).where("x <= px and px < x + w and y <= py and py < y + h")
    best = j.groupBy("point").agg(F.max_by("id", rank).alias("id"))
    return points.select("point").join(best.hint("merge"), "point", "left")


def neighbours(rects: DataFrame, direction: str) -> DataFrame:
    """(id, neighbour) of rectangles (id, depth, x, y, w, h): the one of its depth ahead of least edge gap
    that overlaps across the direction; ties by misalignment, then id. Rectangles with nothing ahead
    have no row; those with a null are left out."""
    at, size, gap = _AHEAD[direction]
    some = rects.select("id", "depth", "x", "y", "w", "h").where("x is not null and y is not null and w is not null and h is not null")
    lv = some.withColumn("_level", level_of(F.col(size)))
    top = lv.agg(F.max("_level")).first()[0]
    if top is None:
        return rects.select("id", F.col("id").alias("neighbour")).limit(0)
    own = lambda d: F.explode(F.array_distinct(F.array(cell_of(F.col(at), F.col("_at")), cell_of(F.col(at) + F.col(size), F.col("_at")))))
    big = lv.withColumn("_at", F.col("_level")).withColumn("_cell", own(lv))
    small = lv.withColumn("_at", F.explode(F.sequence(F.col("_level"), F.lit(top))))
    # only levels that occur at this depth
    occurs = lv.select("depth", F.col("_level").alias("_at")).distinct()
    small = small.join(F.broadcast(occurs), ["depth", "_at"], "left_semi").withColumn("_cell", own(small))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        c, r = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
        # exploded rows are many more than a file's size tells: neither side may be broadcast
        j = a.join(b.hint("merge"), (c("depth") == r("depth")) & (c("_at") == r("_at")) & (c("_cell") == r("_cell")) & (c("id") != r("id")))
        j = j.where((r(at) < c(at) + c(size)) & (r(at) + r(size) > c(at)) & (gap(c, r) >= 0))
        mis = F.abs(r(at) + r(size) / 2 - (c(at) + c(size) / 2))
        return j.select(c("id").alias("id"), r("id").alias("other"), gap(c, r).alias("gap"), mis.alias("mis"))

    found = pairs(big, small).unionByName(pairs(small.where("_at > _level"), big))
    return found.groupBy("id").agg(F.min_by("other", F.struct("gap", "mis", "other")).alias("neighbour"))
