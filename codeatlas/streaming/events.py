"""Streams: change counts that follow a log as it grows, and positions that follow edits.

The batch operators are the reference; these are their counterparts for input that keeps coming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def churn_stream(lines: DataFrame, line: str = "line") -> DataFrame:
    """Running (path, commits) of a stream of numstat lines; for complete or update mode."""
    from codeatlas.operators.churn import counts_from_log

    return counts_from_log(lines, line)


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are dropped with their state."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def latest(snapshots: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The latest snapshot of each generation; for complete mode."""
    return snapshots.groupBy(key).agg(F.max_by(value, seq).alias(value))


def anchors(edits: DataFrame) -> DataFrame:
    """Positions that follow a stream of (anchor, pos, seq, start, end, new_len): the first row of an
    anchor sets its position, later ones edit it. State is one number for each anchor."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pos = state.get[0] if state.exists else None
        for d in frames:
            for r in d.sort_values("seq").itertuples(index=False):
                if pos is None:
                    pos = int(r.pos)
                    continue
                pos = pos + r.new_len - (r.end - r.start) if pos >= r.end else r.start if pos > r.start else pos
        state.update((int(pos),))
        yield pd.DataFrame([(key[0], int(pos))], columns=["anchor", "pos"])

    return edits.groupBy("anchor").applyInPandasWithState(step, "anchor string, pos long", "pos long", "update", "NoTimeout")


def to_memory(df: DataFrame, name: str, mode: str) -> DataStreamWriter:
    return df.writeStream.format("memory").queryName(name).outputMode(mode)


def loading(progress: DataFrame) -> DataFrame:
    """What a load says of itself: (fraction, said) from (phase, done, total)."""
    n = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"))
    some = F.col("total") > 0
    said = (
        F.when(F.col("phase") == 0, "Scanning files…").when((F.col("phase") == 1) & some, F.concat(F.lit("Parsing "), n, F.lit(" files…"))).when(F.col("phase") == 1, "Parsing…")
        .when(F.col("phase") == 2, "Building symbol tree…").when(some, F.concat(F.lit("Packing "), n, F.lit(" nodes...")))
        .otherwise(F.concat(F.lit("Packing "), n, F.lit(" nodes...")))
    )
    share = F.when(F.col("phase") == 0, 0.0).when(F.col("phase") == 2, 1.0).when(some, F.col("done") / F.col("total")).otherwise(0.0)
    return progress.select("*", share.cast("double").alias("fraction"), said.alias("said"))


def current(events: DataFrame, generation: str = "generation", *by: str) -> DataFrame:
    """Events of the newest generation (of each of ``by``), all of them: nothing is lost, and what
    an older load still sends is left out."""
    newest = events.groupBy(*by).agg(F.max(generation).alias("_newest"))
    j = events.join(F.broadcast(newest)) if not by else events.join(newest, list(by))  # without by: one row
    return j.where(F.col(generation) == F.col("_newest")).drop("_newest")


class Loads:
    """Loads of one session, of which a new one ends the one before: its jobs carry a tag."""

    def __init__(self, spark, name: str = "codeatlas-load"):
        self.spark, self.name, self.generation = spark, name, 0

    def start(self) -> str:
        """Ends what the last load still runs, and tags this thread's jobs from now on."""
        if self.generation:
            self.cancel()
        self.generation += 1
        tag = f"{self.name}-{self.generation}"
        self.spark.addTag(tag)
        return tag

    def cancel(self) -> None:
        tag = f"{self.name}-{self.generation}"
        self.spark.interruptTag(tag)
        self.spark.removeTag(tag)
