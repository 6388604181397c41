"""Long texts cut into line or heading chunks, and lines with their byte offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.functions.tables import CHUNK_LINES
from codeatlas.functions.text import heading_label, is_heading, range_label

LINE_ROWS = 256  # texts whose lines are made at once


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, start_byte, end_byte, text): ends include the line end, texts don't. One pass
    over Arrow batches: line ends are found in the bytes of a batch at once, so time and memory are
    linear in a text's bytes however many lines it has, and nothing is shuffled."""
    d = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = T.StructType([d.schema[0], T.StructField("line_no", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start_byte", "end_byte")), T.StructField("text", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, LINE_ROWS):
                yield from _lines(batch.slice(i, LINE_ROWS), [f.name for f in schema.fields])

    return d.mapInArrow(run, schema)


def _lines(b: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    ends = np.flatnonzero(data == 10) + 1
    # a text's last line may lack its end
    open_ = np.flatnonzero((np.diff(off) > 0) & (data[np.maximum(off[1:], 1) - 1] != 10)) if len(data) else np.zeros(0, np.int64)
    ends = np.sort(np.concatenate([ends, off[1:][open_]]))
    if not len(ends):
        return
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(off, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    # texts without the line end and carriage returns before it
    stop = ends - (data[ends - 1] == 10)
    left = np.flatnonzero(stop > starts)
    while len(left := left[data[stop[left] - 1] == 13]):
        stop[left] -= 1
        left = left[stop[left] > starts[left]]
    cuts = np.empty(2 * len(ends) + 1, np.int64)
    cuts[0], cuts[1::2], cuts[2::2] = 0, stop, ends
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    line = every.take(pa.array(np.arange(0, 2 * len(ends), 2))).cast(pa.binary()).cast(pa.string())
    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), *(pa.array(x) for x in ((np.arange(len(doc)) - first[doc]).astype(np.int32), starts - off[doc], ends - off[doc])), line], names)


def fixed(lines: DataFrame, key: str, size: int = CHUNK_LINES) -> DataFrame:
    """Chunks of at most ``size`` lines: (key, chunk, start_line, end_line, start_byte, end_byte, label)."""
    g = lines.groupBy(key, F.floor(F.col("line_no") / size).cast("long").alias("chunk")).agg(
        F.min("line_no").cast("long").alias("start_line"), (F.max("line_no") + 1).cast("long").alias("end_line"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")
    )
    return g.withColumn("label", range_label(F.col("start_line"), F.col("end_line")))


def heading_starts(lines: Column, size: int = CHUNK_LINES) -> Column:
    """Start lines of heading chunks, by a fold over an array of lines: at a heading (the first
    one takes in what stands before it), or at a blank line once ``size`` lines have gone by."""
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"), is_heading(F.get(lines, 0)).alias("seen"), F.lit(1).alias("i"))

    def step(acc: Column, line: Column) -> Column:
        head = is_heading(line)
        new = (head & acc["seen"]) | (~head & line.rlike(r"(?U)^\s*$") & (acc["i"] - acc["at"] >= size))
        return F.struct(F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"), F.when(new, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["seen"] | head).alias("seen"), (acc["i"] + 1).alias("i"))

    return F.when(F.size(lines) > 0, F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), first, step)["starts"]).otherwise(F.array().cast("array<int>"))


def headings(docs: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, chunk, start_line, end_line, label) of each document's heading chunks."""
    d = docs.select(key, F.col(lines).alias("l"), heading_starts(F.col(lines)).alias("s"))
    d = d.select(key, "l", "s", F.posexplode("s").alias("chunk", "start_line"))
    end = F.coalesce(F.get("s", F.col("chunk") + 1), F.size("l"))
    head = F.get("l", F.col("start_line"))
    return d.select(key, "chunk", "start_line", end.alias("end_line"), F.when(is_heading(head), heading_label(head)).otherwise(range_label(F.col("start_line"), end)).alias("label"))
