"""Innermost enclosing intervals: of points, and of other intervals.

Starts and points are dealt in ranges of (key, position), so a large file is cut like any other rows.
What is still open where a range begins is handed on to it: the intervals of the same key from ranges
before that reach its first place. Within a range all answers come from one pass in numpy: intervals lie
in the order of their starts, longer first, and a tree of maxima over their ends finds, for every point at
once, the last one before it that hasn't ended. That holds for nested intervals and for crossing ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.plans.lineage import saved


def last_above(ends: np.ndarray, count: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each question the last index below ``count`` whose end is above ``limit``, or -1.

    Prefixes fall into blocks of a power of two; blocks are tried from the right by their maxima, and
    the first that will do is halved down to one place."""
    n = len(ends)
    levels = [np.asarray(ends, np.int64)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        if len(x) % 2:
            x = np.append(x, np.iinfo(np.int64).min)
        levels.append(np.maximum(x[::2], x[1::2]))
    left, level = np.minimum(count, n).astype(np.int64), np.full(len(count), -1)
    block = np.zeros(len(count), np.int64)
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        size = left[open_] & -left[open_]
        at_level = np.log2(size).astype(np.int64)  # exact: a power of two
        at = (left[open_] >> at_level) - 1
        best = np.empty(len(open_), np.int64)
        for k in np.unique(at_level).tolist():
            same = at_level == k
            best[same] = levels[k][at[same]]
        hit = best > limit[open_]
        level[open_[hit]], block[open_[hit]] = at_level[hit], at[hit]
        left[open_] -= np.where(hit, left[open_], size)
        open_ = open_[left[open_] > 0]
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(level == k)
        if len(down):
            right = 2 * block[down] + 1
            some = np.minimum(right, len(levels[k - 1]) - 1)
            take = (right < len(levels[k - 1])) & (levels[k - 1][some] > limit[down])
            block[down] = np.where(take, right, right - 1)
            level[down] = k - 1
    return np.where(level == 0, block, -1)


_ORDER = ["_key", "_pos", "_kind", "_back", "_id"]
RANGE = 200_000  # events of a range: what one Python task sorts at once


def _answers(events: pa.Table) -> pa.Table:
    """The range's questions with the innermost interval of each."""
    events = events.take(pc.sort_indices(events, sort_keys=[(c, "ascending") for c in _ORDER]))
    keys = events.column("_key").combine_chunks().dictionary_encode()
    code = np.asarray((keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).indices, np.int64)
    give, ask = (np.asarray(events.column(c)) for c in ("_give", "_ask"))
    ends = -np.asarray(events.column("_back"), np.int64)
    given = np.flatnonzero(give)
    before = np.concatenate([[0], np.cumsum(give)])[:-1]  # intervals ahead of each row in the order
    at = np.flatnonzero(ask)
    found = last_above(ends[given], before[at], np.asarray(events.column("_limit"), np.int64)[at])
    source = given[np.maximum(found, 0)] if len(given) else np.zeros(len(at), np.int64)
    # one of an earlier key means that no interval of this key is open
    known = (found >= 0) & (code[source] == code[at]) if len(given) else np.zeros(len(at), bool)
    take = pa.array(source, mask=~known)
    rows = events.take(pa.array(at))
    start = events.column("_pos").take(take)
    return pa.table([rows.column("_key"), rows.column("_id"), rows.column("_pos"), rows.column("_end"), events.column("_id").take(take), start, events.column("_end").take(take)], names=["_key", "_id", "_pos", "_end", "inner", "inner_start", "inner_end"])


def _swept(events: DataFrame) -> DataFrame:
    """Answers to all questions among events (_key, _pos, _kind, _back, _id, _end, _limit, _give, _ask)."""
    # a number of ranges that grows with the events, so that a range doesn't: its events are one Arrow table
    least = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-events.count() // RANGE))
    dealt = saved(events.repartitionByRange(ranges, *_ORDER).withColumn("_range", F.spark_partition_id()))
    # one row a range: where it begins
    heads = dealt.groupBy("_range").agg(F.min(F.struct("_key", "_pos")).alias("h")).select(F.col("_range").alias("_next"), F.col("h._key").alias("_key"), F.col("h._pos").alias("_first"))
    handed = dealt.where("_give").join(F.broadcast(heads), "_key").where("_range < _next and _end >= _first")
    handed = handed.withColumn("_range", F.col("_next")).withColumn("_ask", F.lit(False)).select(*dealt.columns)
    key, id_ = events.schema["_key"].dataType, events.schema["_id"].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField(n, t) for n, t in (("_key", key), ("_id", id_), ("_pos", long), ("_end", long), ("inner", id_), ("inner_start", long), ("inner_end", long))])
    return dealt.unionByName(handed).groupBy("_range").applyInArrow(_answers, schema)


def _intervals(rows: DataFrame, key: str, id_: str, start: str, end: str, ask: bool) -> DataFrame:
    c = lambda n: F.col(f"`{n}`")
    some = rows.where(c(key).isNotNull() & c(id_).isNotNull() & c(start).isNotNull() & c(end).isNotNull())
    e = c(end).cast("long")
    return some.select(c(key).alias("_key"), c(start).cast("long").alias("_pos"), F.lit(0).alias("_kind"), (-e).alias("_back"), c(id_).alias("_id"), e.alias("_end"), (e - 1).alias("_limit"), F.lit(True).alias("_give"), F.lit(ask).alias("_ask"))


def innermost(points: DataFrame, intervals: DataFrame, key: str = "key", at: str = "at", id_: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """(key, id, at, inner, inner_start, inner_end): for each point (key, id, at) the interval (key, id,
    start, end; end exclusive) of its key that holds it and began last; of those the shortest, then the
    last by id. Null where none holds it, and for points without key or position. Intervals with a null
    hold nothing, nor do empty ones; repeated points stay. Ids of points and intervals are of one type."""
    c = lambda n: F.col(f"`{n}`")
    whole = c(key).isNotNull() & c(at).isNotNull()
    p = c(at).cast("long")
    none = F.lit(None).cast("long")
    asked = points.where(whole).select(c(key).alias("_key"), p.alias("_pos"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_back"), c(id_).alias("_id"), none.alias("_end"), p.alias("_limit"), F.lit(False).alias("_give"), F.lit(True).alias("_ask"))
    found = _swept(_intervals(intervals, key, id_, start, end, False).unionByName(asked))
    out = found.select(F.col("_key").alias(key), F.col("_id").alias(id_), F.col("_pos").alias(at), "inner", "inner_start", "inner_end")
    lost = points.where(~whole).select(c(key), c(id_), p.alias(at), F.lit(None).cast(found.schema["inner"].dataType).alias("inner"), none.alias("inner_start"), none.alias("inner_end"))
    return out.unionByName(lost)


def parents(intervals: DataFrame, key: str = "key", id_: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """(key, id, start, end, parent, parent_start, parent_end): for each interval the one of its key that
    holds it whole and comes last before it by start, longer first, then id. Of equal intervals each is
    in the one before it. Null for outermost ones; intervals with a null are left out."""
    found = _swept(_intervals(intervals, key, id_, start, end, True))
    return found.select(F.col("_key").alias(key), F.col("_id").alias(id_), F.col("_pos").alias(start), F.col("_end").alias(end), F.col("inner").alias("parent"), F.col("inner_start").alias("parent_start"), F.col("inner_end").alias("parent_end"))
