"""Heading chunks by ranges of lines, against the fold over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import chunks, sections


@pytest.mark.parametrize("lines_a_range", [7, 64, 1 << 14])
def test_equal_to_the_fold(spark, lines_a_range):
    rng = random.Random(lines_a_range)
    texts = [[rng.choices(["# a", " ## b ", "", "  ", "x", None], [h, h, 2, 1, 9, 1])[0] for _ in range(rng.randint(1, 400))] for h in (0, 0.01, 0.1, 1, 5) for _ in range(6)]
    rows = [(i if i else None, n, s, "z") for i, t in enumerate(texts) for n, s in enumerate(t)]
    rng.shuffle(rows)
    lines = spark.createDataFrame([*rows, (3, None, "# no line", "z")], "k long, line long, s string, r string")
    got = {tuple(r) for r in sections.headings(lines, "k", "line", "s", size=20, lines_a_range=lines_a_range).collect()}
    whole = spark.createDataFrame([(i if i else None, ["-" if s is None else s for s in t]) for i, t in enumerate(texts)], "k long, l array<string>")
    starts = whole.select("k", "l", chunks.heading_starts(F.col("l"), 20).alias("s")).collect()
    want = set()
    for r in starts:
        for a, z in zip(r["s"], [*r["s"][1:], len(r["l"])], strict=True):
            head = r["l"][a].strip()
            want.add((r["k"], a, z, head.lstrip("# ") if head.startswith("#") else f"{a + 1}\u2013{z}"))
    assert got == want and len(want) > 100


def test_empty_and_no_events(spark):
    none = spark.createDataFrame([], "k string, line int, s string")
    assert sections.headings(none, "k", "line", "s").count() == 0
    plain = spark.createDataFrame([("a", i, "x") for i in range(50)] + [("b", 0, "# t")], "k string, line int, s string")
    assert {tuple(r) for r in sections.headings(plain, "k", "line", "s", size=5, lines_a_range=8).collect()} == {("a", 0, 50, "1\u201350"), ("b", 0, 1, "t")}


def test_a_long_text_in_many_tasks(spark):
    n = 400_000
    lines = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("line"), F.when(F.col("id") % 7919 == 5, "# h").when(F.col("id") % 13 == 0, "").otherwise("x").alias("s"))
    got = [(r["start_line"], r["end_line"]) for r in sections.headings(lines, "k", "line", "s", lines_a_range=4096).orderBy("start_line").collect()]
    want, at = [0], 0
    for i in range(1, n):
        if (i % 7919 == 5 and i > 5) or (i % 7919 != 5 and i % 13 == 0 and i - at >= 60):
            want.append(i)
            at = i
    assert got == list(zip(want, [*want[1:], n], strict=True))
