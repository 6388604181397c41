"""What loads send while they run, kept in state: control events in order and without loss, and a
mailbox with one place for snapshots.

Both are for event time: the stream has a watermark on its time column, and timers fire as it passes. The
session's state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``). State for a
session is its newest generation and what waits there; older generations leave no state behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CONTROL = "session string, generation long, seq long, event string, late boolean"
_SNAPSHOT = "session string, generation long, seq long, snapshot string"


class _Control(StatefulProcessor):
    """Events of the newest generation by their numbers, from 0 on. One that comes early waits for those
    before it, for ``patience`` at most: then what waits goes on, and what comes after its turn is marked late."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "generation long, next long, timer long")
        self.waiting = handle.getMapState("waiting", "seq long", "event string")
        self.told = handle.getMapState("told", "first long", "end long")  # runs of numbers that were passed over

    def _flow(self, key, generation: int, turn: int, out: list) -> int:
        while self.waiting.containsKey((turn,)):
            out.append((key, generation, turn, self.waiting.getValue((turn,))[0], False))
            self.waiting.removeKey((turn,))
            turn += 1
        return turn

    def _empty(self) -> bool:
        return next(iter(self.waiting.keys()), None) is None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, turn, timer = self.turn.get() if self.turn.exists() else (-1, 0, 0)
        out: list[tuple] = []
        now = timerValues.getCurrentWatermarkInMs()
        for d in rows:
            now = max(now, int(d["ms"].max()))
            for r in d.sort_values(["generation", "seq"]).itertuples(index=False):
                if r.generation < generation:
                    continue  # an older load goes on sending: nobody listens
                if r.generation > generation:
                    generation, turn = int(r.generation), 0
                    self.waiting.clear()
                    self.told.clear()
                if r.seq >= turn:
                    self.waiting.updateValue((int(r.seq),), (r.event,))
                elif run := next(((a[0], b[0]) for a, b in list(self.told.iterator()) if a[0] <= r.seq < b[0]), None):
                    self.told.removeKey((run[0],))
                    for a, b in ((run[0], int(r.seq)), (int(r.seq) + 1, run[1])):
                        if a < b:
                            self.told.updateValue((a,), (b,))
                    out.append((key[0], generation, int(r.seq), r.event, True))
        turn = self._flow(key[0], generation, turn, out)
        if timer and self._empty():
            self.handle.deleteTimer(timer)
            timer = 0
        elif not timer and not self._empty():
            timer = now + self.patience
            self.handle.registerTimer(timer)
        self.turn.update((generation, turn, timer))
        yield pd.DataFrame(out, columns=["session", "generation", "seq", "event", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, turn, _ = self.turn.get()
        out: list[tuple] = []
        for seq in sorted(k[0] for k in list(self.waiting.keys())):
            if turn < seq:
                self.told.updateValue((turn,), (seq,))
            turn = self._flow(key[0], generation, seq, out) if seq >= turn else turn
        self.turn.update((generation, turn, 0))
        yield pd.DataFrame(out, columns=["session", "generation", "seq", "event", "late"])

    def close(self) -> None:
        pass


class _Mailbox(StatefulProcessor):
    """The newest snapshot of the newest generation, handed out when ``every`` has passed since the first
    that came in after the last one handed out. What was overtaken is gone."""

    def __init__(self, every_ms: int):
        self.every = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "generation long, seq long, snapshot string, full boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.place.get() if self.place.exists() else (-1, -1, None, False)
        best = tuple(held)
        now = timerValues.getCurrentWatermarkInMs()
        for d in rows:
            now = max(now, int(d["ms"].max()))
            for r in d.itertuples(index=False):
                if (int(r.generation), int(r.seq)) > best[:2]:
                    best = (int(r.generation), int(r.seq), r.snapshot, True)
        if best[3] and not held[3]:
            self.handle.registerTimer(now + self.every)
        if best != tuple(held):
            self.place.update(best)
        yield pd.DataFrame([], columns=["session", "generation", "seq", "snapshot"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, seq, snapshot, full = self.place.get()
        self.place.update((generation, seq, None, False))
        yield pd.DataFrame([(key[0], generation, seq, snapshot)] if full else [], columns=["session", "generation", "seq", "snapshot"])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, value: str, time: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.withWatermark(time, late).select("session", "generation", "seq", value, F.unix_millis(F.col(time)).alias("ms"), F.col(time))
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=T._parse_datatype_string(schema), outputMode="Append", timeMode="EventTime")


def control(events: DataFrame, time: str, late: str = "10 seconds", patience_ms: int = 5000) -> DataFrame:
    """(session, generation, seq, event, late) of a stream of control events (session, generation, seq,
    event, and a time): each session's newest generation in order of seq. Every event of that
    generation comes out once, repeated ones too; of older generations nothing more does."""
    return _stateful(events, "event", time, late, _Control(patience_ms), _CONTROL)


def mailbox(snapshots: DataFrame, time: str, late: str = "10 seconds", every_ms: int = 1000) -> DataFrame:
    """(session, generation, seq, snapshot): of a stream of snapshots each session's newest one, at most
    once in ``every_ms`` of the stream's time."""
    return _stateful(snapshots, "snapshot", time, late, _Mailbox(every_ms), _SNAPSHOT)
