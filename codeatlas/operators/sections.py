"""Heading chunks of texts larger than a task, from rows of lines.

Where a chunk begins depends on where the last one began, so one text is a chain from its first line
to its last. It is cut into ranges of lines all the same: only headings and blank lines can begin a
chunk, and what a range does depends on nothing but the first line at which a blank line may begin
one, which lies among the first ``size`` lines of the range. Each range answers all of those at once
by jumping along its chains; the answers of a text's ranges are composed in order, a few hundred
bytes for each range, and with its own entry known every range then gives its chunks by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.tables import CHUNK_LINES
from codeatlas.functions.text import heading_label, is_heading, range_label
from codeatlas.plans.lineage import saved

RANGE = 1 << 14  # lines of a text that a task has at once


def _chains(line: np.ndarray, hard: np.ndarray, size: int) -> np.ndarray:
    """For each event (a heading, or a blank line) that begins a chunk the event that begins the next:
    the next heading, or an earlier blank line at ``size`` lines or more. len(line): none."""
    n = len(line)
    headings = np.append(np.flatnonzero(hard), n)
    after = headings[np.searchsorted(headings[:-1], np.arange(n), "right")]
    return np.minimum(after, np.searchsorted(line, line + size))


def _first(line: np.ndarray, hard: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first event that begins a chunk where a blank line does so from line ``least``."""
    heading = int(np.argmax(hard)) if hard.any() else len(line)
    return np.minimum(heading, np.searchsorted(line, least))


def exits(line: np.ndarray, hard: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """For each first line where a blank line may begin a chunk, the line at which a range's last
    chunk begins; -1 where none begins in it."""
    n = len(line)
    last = np.append(_chains(line, hard, size), n)
    last[:n] = np.where(last[:n] == n, np.arange(n), last[:n])  # an end of a chain leads to itself
    while not np.array_equal(far := last[last], last):
        last = far
    end = last[_first(line, hard, least)]
    return np.where(end == n, -1, np.append(line, -1)[end])


def starts(line: np.ndarray, hard: np.ndarray, low: int, at: int, size: int) -> list[int]:
    """Lines of a range that begin chunks, where the chunk before it began at line ``at``."""
    after, out = _chains(line, hard, size), []
    i = int(_first(line, hard, np.array([max(at + size, low)]))[0])
    while i < len(line):
        out.append(int(line[i]))
        i = int(after[i])
    return out


def headings(lines: DataFrame, key: str, line: str, text: str, size: int = CHUNK_LINES, lines_a_range: int = RANGE) -> DataFrame:
    """(key, start_line, end_line, label) of each text's heading chunks: those of chunks.headings, for
    texts of any number of lines. ``line`` counts a text's lines from 0 in its order, each once; it may
    skip numbers, then distances are those of the numbers. A heading begins a chunk, but for the
    first one, which takes in what stands before it; so does a blank line ``size`` lines on. Texts are
    told apart by ``key``, null keys are one text; rows without a line number are no lines, null
    texts are lines that are neither. No task holds more than a range of a text's headings and blank lines;
    composing costs ``size`` numbers a range."""
    d = lines.where(F.col(line).isNotNull()).select(F.col(key).alias("k"), F.col(line).cast("long").alias("at"), F.coalesce(F.col(text), F.lit("-")).alias("s"))
    d = d.select("k", "at", is_heading("s").alias("head"), F.col("s").rlike(r"(?U)^\s*$").alias("blank"), F.when(is_heading("s"), heading_label("s")).alias("label"))
    whole = d.groupBy("k").agg((F.max("at") + 1).alias("end"), F.min("at").alias("begin"), F.min(F.when(F.col("head"), F.col("at"))).alias("h0"))
    # the first heading of a text begins no chunk (one in its first line begins the first)
    event = d.where("head or blank").select("k", "at", "head").join(whole.select(F.col("k").alias("k0"), "begin", "h0"), F.col("k").eqNullSafe(F.col("k0")))
    event = event.where("at > begin and not (head and at = h0)").withColumn("r", F.floor(F.col("at") / lines_a_range).cast("long"))
    packed = event.groupBy("k", "r").agg(F.sort_array(F.collect_list(F.struct("at", "head"))).alias("e"), F.first("begin").alias("begin"))
    packed = saved(packed.select("k", "r", "begin", F.col("e.at").alias("at"), F.col("e.head").alias("head")))

    def answers(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for r, begin, x, h in zip(b.r, b.begin, b["at"], b["head"], strict=True):
                low = r * lines_a_range
                # the range that a text begins in has one entry only
                least = np.full(size, begin + size) if begin >= low else low + np.arange(size)
                out.append(exits(np.asarray(x), np.asarray(h, bool), least, size))
            yield pd.DataFrame({**{c: b[c] for c in ("k", "r", "begin")}, "out": out})

    of_key = f"k {lines.schema[key].dataType.simpleString()}, r long, begin long"
    entry = _composed(packed.mapInPandas(answers, f"{of_key}, out array<long>"), size, lines_a_range)

    def cuts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = [starts(np.asarray(x), np.asarray(h, bool), r * lines_a_range, int(a), size) for r, x, h, a in zip(b.r, b["at"], b["head"], b["entry"], strict=True)]
            yield pd.DataFrame({**{c: b[c] for c in ("k", "r", "begin")}, "s": out})

    same = F.col("k").eqNullSafe(F.col("k1")) & (F.col("r") == F.col("r1"))
    cut = packed.join(entry.select(F.col("k").alias("k1"), F.col("r").alias("r1"), "entry"), same).select("k", "r", "begin", "at", "head", "entry").mapInPandas(cuts, f"{of_key}, s array<long>")
    # a text's first chunk, which no event begins; then the next range's first start ends a range's last chunk
    cut = cut.where(F.size("s") > 0).unionByName(whole.select("k", F.lit(-1).cast("long").alias("r"), "begin", F.array("begin").alias("s")))
    following = F.lead(F.get("s", F.lit(0))).over(Window.partitionBy("k").orderBy("r"))
    cut = cut.select("k", "s", following.alias("next")).join(whole.select(F.col("k").alias("k0"), "end"), F.col("k").eqNullSafe(F.col("k0")))
    one = cut.select("k", "s", F.coalesce("next", "end").alias("stop"), F.posexplode("s").alias("i", "start_line"))
    one = one.select("k", "start_line", F.coalesce(F.get("s", F.col("i") + 1), "stop").alias("end_line"))
    said = d.where("head").select(F.col("k").alias("k2"), F.col("at").alias("at2"), "label")
    one = one.join(said, F.col("k").eqNullSafe(F.col("k2")) & (F.col("start_line") == F.col("at2")), "left")
    return one.select(F.col("k").alias(key), "start_line", "end_line", F.coalesce("label", range_label(F.col("start_line"), F.col("end_line"))).alias("label"))


def _composed(answers: DataFrame, size: int, lines_a_range: int) -> DataFrame:
    """(k, r, entry): the line at which the chunk before a range began, from the answers of the ranges
    before it (in one fold for each text, over ``size`` numbers a range)."""
    steps = F.sort_array(F.collect_list(F.struct("r", "out")))
    found = answers.groupBy("k").agg(steps.alias("steps"), F.first("begin").alias("begin"))

    def step(acc: Column, x: Column) -> Column:
        at = F.element_at(acc, -1)
        low = x["r"] * lines_a_range
        done = F.get(x["out"], F.least(F.greatest(at + size, low) - low, F.lit(size - 1)).cast("int"))
        return F.concat(acc, F.array(F.when(done >= 0, done).otherwise(at)))

    entries = F.aggregate("steps", F.array("begin"), step)
    return found.select("k", "steps", entries.alias("entries")).select("k", F.posexplode("steps").alias("i", "x"), "entries").select("k", F.col("x.r").alias("r"), F.get("entries", F.col("i")).alias("entry"))
