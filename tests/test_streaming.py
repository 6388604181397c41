import datetime
import random

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import hierarchy
from codeatlas.streaming import events, loads, rollups


def drain(df, name, mode):
    q = events.to_memory(df, name, mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").collect())


def test_churn_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h1\n1\t2\tx.py\n-\t-\ty.png\n")
    (tmp_path / "b.txt").write_text("h2\n3\t0\tx.py\n")
    lines = spark.readStream.text(str(tmp_path)).withColumnRenamed("value", "line")
    assert drain(events.churn_stream(lines), "churn_out", "complete") == [("x.py", 2), ("y.png", 1)]


def test_windows(spark, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(events.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour"), "win_out", "complete")
    want = sorted(tuple(r) for r in table.groupBy("ts", "event_type").count().selectExpr("date_trunc('DAY', ts) d", "event_type", "count").groupBy("d", "event_type").sum("count").collect())
    assert got == want


def test_anchors(spark, tmp_path):
    cols = "anchor string, pos long, seq int, start long, end long, new_len long"
    rows = [("a", 100, 0, None, None, None), ("a", None, 1, 50, 50, 10), ("a", None, 2, 200, 200, 5), ("a", None, 3, 105, 120, 1)]
    spark.createDataFrame(rows, cols).coalesce(1).write.json(str(tmp_path / "in"))
    assert drain(events.anchors(spark.readStream.schema(cols).json(str(tmp_path / "in"))), "anchor_out", "update") == [("a", 105)]


# -- loads ----------------------------------------------------------------------------------


def fed(spark, tmp_path, schema, batches, make, name):
    """The output of a stream whose batches are these rows, by the times of arrival."""
    import os

    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        part = str(tmp_path / f"{name}-{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{file}", folder / f"{i:03d}.parquet")
        os.utime(folder / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    conf = {"spark.sql.streaming.stateStore.providerClass": loads.ROCKSDB, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        q = events.to_memory(make(stream), name, "append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_control_events(spark, tmp_path):
    schema = "session string, generation long, seq long, event string, time timestamp"
    batches = [
        [("s", 1, 1, "b", at(0)), ("t", 1, 0, "x", at(0))],  # 0 is still to come
        [("s", 1, 0, "a", at(1)), ("s", 1, 3, "d", at(1))],
        [("s", 1, 2, "c", at(2)), ("t", 1, 2, "z", at(2))],  # t waits for 1
        [("s", 2, 0, "A", at(3)), ("s", 1, 4, "old", at(3))],  # a new load; the old one goes on sending
        [("s", 1, 5, "old", at(4)), ("s", 2, 1, "B", at(4))],
        [("u", 1, 0, "later", at(60))],  # time passes: t's patience ends
        [("u", 1, 1, "later", at(90))],
        [("t", 1, 1, "y", at(91)), ("t", 1, 3, "w", at(92))],  # late, but not lost
    ]
    got = fed(spark, tmp_path, schema, batches, lambda s: loads.control(s, "time", "1 second", 5000), "control_out")
    of = lambda session: [r[1:] for r in got if r[0] == session]
    assert of("s") == [(1, 0, "a", False), (1, 1, "b", False), (1, 2, "c", False), (1, 3, "d", False), (2, 0, "A", False), (2, 1, "B", False)]
    assert of("t") == [(1, 0, "x", False), (1, 2, "z", False), (1, 1, "y", True), (1, 3, "w", False)]


def test_mailbox(spark, tmp_path):
    schema = "session string, generation long, seq long, snapshot string, time timestamp"
    batches = [
        [("s", 1, 1, "one", at(0)), ("s", 1, 3, "three", at(0)), ("s", 1, 2, "two", at(0))],
        [("s", 2, 0, "new", at(1)), ("s", 1, 9, "superseded", at(1))],
        [("x", 1, 0, "tick", at(30))],
        [("x", 1, 1, "tick", at(60))],
        [("s", 1, 10, "superseded", at(61)), ("s", 2, 1, "newer", at(62))],
        [("x", 1, 2, "tick", at(120))],
        [("x", 1, 3, "tick", at(150))],
    ]
    got = fed(spark, tmp_path, schema, batches, lambda s: loads.mailbox(s, "time", "1 second", 5000), "mailbox_out")
    assert [r for r in got if r[0] == "s"] == [("s", 2, 0, "new"), ("s", 2, 1, "newer")]


def test_loads_need_rocksdb(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        loads.mailbox(spark.createDataFrame([], "session string, generation long, seq long, snapshot string, time timestamp"), "time")


# -- maintained rollups ---------------------------------------------------------------------


def check_store(spark, store, state):
    files = spark.createDataFrame([(p, *v) for p, v in state.items()], "path string, lines long, commits long")
    want = hierarchy.rollup(files, "path", F.count("*").alias("n"), F.sum("lines").alias("l"), F.sum("commits").alias("c")).collect()
    assert {tuple(r) for r in store.folders().collect()} == {tuple(r) for r in want}
    assert {tuple(r) for r in store.files().collect()} == {(p, *v) for p, v in state.items()}
    ranks = {r["path"]: r["percentile"] for r in hierarchy.percentile(files, "commits").collect()}
    got = {r["path"]: r["percentile"] for r in store.percentiles().collect()}
    assert got.keys() == ranks.keys() and all(abs(got[p] - ranks[p]) < 1e-12 for p in got)


def test_rollups_follow_edits(spark, tmp_path):
    """After each set of random edits the store equals a rollup of all files."""
    rng, state = random.Random(4), {}
    store = rollups.Store(spark, f"file://{tmp_path}/store", 5)
    schema = "path string, lines long, commits long"
    for step in range(4):
        edits = {}
        for _ in range(12 if step else 40):
            p = "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) + f"/f{rng.randint(0, 9)}"
            edits[p] = (None, None) if p in state and rng.random() < 0.4 else (rng.randint(0, 99), rng.randint(0, 5))
        assert store.apply(spark.createDataFrame([(p, *v) for p, v in edits.items()], schema)) == step + 1
        state = {p: v for p, v in (state | edits).items() if v[0] is not None}
        check_store(spark, rollups.Store(spark, f"file://{tmp_path}/store"), state)
    assert store.apply(spark.createDataFrame([], schema)) == 4
    assert store.apply(spark.createDataFrame([(p, None, None) for p in state], schema)) == 5
    assert store.folders().collect() == [] and store.files().collect() == [] and store.percentiles().collect() == []


def test_rollups_touch_few_buckets(spark, tmp_path):
    store = rollups.Store(spark, f"file://{tmp_path}/store", 32)
    schema = "path string, lines long, commits long"
    store.apply(spark.createDataFrame([(f"d{i}/f{j}", i, j) for i in range(30) for j in range(5)], schema))
    before = store._manifest()["at"]
    store.apply(spark.createDataFrame([("d3/f1", 100, 9)], schema))
    after = store._manifest()["at"]
    changed = {t: sum(before[t].get(b) != after[t].get(b) for b in after[t].keys() | before[t].keys()) for t in after}
    assert changed["files"] == 1 and changed["folders"] <= 2 and changed["values"] <= 2


def test_rollups_of_a_stream(spark, tmp_path):
    """Batches that come again are merged once."""
    schema = "path string, lines long, commits long"
    store = rollups.Store(spark, f"file://{tmp_path}/store", 4)
    for name, rows in (("1", [("a/x", 1, 1), ("a/y", 2, 2)]), ("2", [("a/x", 5, 3), ("b/z", 1, 1), ("a/y", None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = store.follow(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
    check_store(spark, store, {"a/x": (5, 3), "b/z": (1, 1)})
    version = store._manifest()["version"]
    assert store.apply(spark.createDataFrame([("a/x", 99, 9)], schema), 0) == version
