"""Rows in global key order without a window over all rows: explicit range bounds.

Bounds come from a sample of the key column alone, so texts are shuffled once, and the same
bounds hold however often the plan is run (Spark's own range partitioner may pick others when
a lost task's stage is run anew)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 increasing keys that cut the rows into parts of like size; n is a number of
    partitions, so what reaches the driver doesn't grow with the rows."""
    if n < 2:
        return []
    q = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("q")).first()
    return sorted(set(q["q"] or []))


def part_of(key: str, cuts: list[int]):
    """The number of bounds at or below the key: equal keys share a part; null goes first."""
    if not cuts:
        return F.lit(0)
    # binary search by nested conditions would be deep; an array of bounds is searched in the JVM
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col(key))), F.lit(0)) if len(cuts) < 64 else _tree(key, cuts, 0)


def _tree(key: str, cuts: list[int], base: int):
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(F.col(key) < cuts[m], _tree(key, cuts[:m], base)).when(F.col(key).isNull(), F.lit(0)).otherwise(_tree(key, cuts[m + 1 :], base + m + 1))
