"""Spans over lines, and byte positions that survive edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_line(spans: DataFrame, lines: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """Spans (key, start, end, kind) clipped to each line (key, line_no, start_byte, end_byte) that
    they overlap. Buckets of bytes make the range join an equi-join."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(F.greatest(b - 1, a) / bucket)))
    s = spans.withColumn("_b", cut(F.col("start"), F.col("end")))
    li = lines.withColumn("_b", cut(F.col("start_byte"), F.col("end_byte")))
    j = s.join(li, [key, "_b"]).where("start < end_byte and end > start_byte")
    # a pair that shares several buckets counts in the first of them
    j = j.where(F.col("_b") == F.floor(F.greatest("start", "start_byte") / bucket))
    return j.select(key, "line_no", (F.greatest("start", "start_byte") - F.col("start_byte")).alias("s"), (F.least("end", "end_byte") - F.col("start_byte")).alias("e"), "kind")


def offset_to_line(offsets: DataFrame, lines: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """(key, offset, line_no): the line that holds a byte offset."""
    o = offsets.withColumn("_b", F.floor(F.col("offset") / bucket))
    li = lines.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_byte") / bucket), F.floor(F.greatest(F.col("end_byte") - 1, F.col("start_byte")) / bucket))))
    return o.join(li, [key, "_b"]).where("offset >= start_byte and offset < end_byte").select(key, "offset", "line_no")


def without_overlap(spans: Column) -> Column:
    """Greedy: spans (start, end, ...) by start, longer first; kept where they begin at or after
    the end of the last one kept."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    none = F.slice(order, 1, 0)
    return F.aggregate(order, none, lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(F.concat(acc, F.array(s)), F.greatest(F.size(acc), F.lit(1)))["end"]), F.concat(acc, F.array(s))).otherwise(acc))


def remap(pos: Column, edits: Column) -> Column:
    """A position after edits (start, end, new_len) in order: at or after an edit's end it moves
    with it, strictly inside it falls back to its start."""
    move = lambda p, e: F.when(p >= e["end"], p + e["new_len"] - (e["end"] - e["start"])).when(p > e["start"], e["start"]).otherwise(p)
    return F.aggregate(edits, pos.cast("long"), lambda p, e: move(p, e).cast("long"))


def dominant_kind(spans: DataFrame, key: str, kind: str = "kind", weight: str = "weight", seq: str = "seq") -> DataFrame:
    """Per key the kind of most weight; of equal ones the first seen."""
    s = spans.groupBy(key, kind).agg(F.sum(weight).alias("_w"), F.min(seq).alias("_s"))
    return s.groupBy(key).agg(F.max_by(kind, F.struct("_w", -F.col("_s"))).alias(kind))
