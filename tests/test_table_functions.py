"""Table functions in SQL: callables of one's own, odd rows."""

import pytest

from codeatlas.functions import table_functions
from codeatlas.parse import Item


def test_own_parser_and_resolver(spark):
    def todo(source: bytes) -> list[Item]:
        at = [i for i in range(len(source)) if source.startswith(b"TODO", i)]
        return [Item("fn", f"todo{n}", i, i + 4) for n, i in enumerate(at)]

    table_functions.register(spark, parsers={"notes": todo}, resolvers={"notes": lambda source, ext, start, end, around, classes, returns: {"at": str(start)}})
    d = spark.createDataFrame([(1, "TODO a\nTODO b"), (2, None), (3, "")], "id int, t string")
    d.createOrReplaceTempView("own_notes")
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert rows("SELECT id, n, name, lines, depth FROM own_notes, LATERAL parse_items('notes', t)") == [(1, 0, "todo0", 1, 1), (1, 1, "todo1", 1, 1)]
    assert rows("SELECT id, function, variable, class FROM own_notes, LATERAL type_bindings('notes', t)") == [(1, "todo0", "at", "0"), (1, "todo1", "at", "7")]
    assert rows("SELECT id FROM own_notes, LATERAL parse_items('unknown', t)") == rows("SELECT id FROM own_notes, LATERAL type_bindings(CAST(NULL AS STRING), t)") == []


def test_chunk_strategies(spark):
    table_functions.register(spark)
    lines = [("a", i, s) for i, s in enumerate(["x", "# A", None, "", "y", "", "## B ", "z"])] + [(None, 0, "# n"), (None, 1, "")]
    spark.createDataFrame(lines[::-1], "k string, n int, s string").createOrReplaceTempView("odd_lines")
    chunks = lambda how, size: {tuple(r) for r in spark.sql(f"SELECT * FROM chunk_lines(TABLE(odd_lines) PARTITION BY (k) ORDER BY (n), '{how}', {size})").collect()}
    assert chunks("headings", 4) == {("a", 0, 5, "1–5"), ("a", 5, 6, "6–6"), ("a", 6, 8, "B"), (None, 0, 2, "n")}
    assert chunks("lines", 3) == {("a", 0, 3, "1–3"), ("a", 3, 6, "4–6"), ("a", 6, 8, "7–8"), (None, 0, 2, "1–2")}
    spark.sql("SELECT * FROM odd_lines WHERE false").createOrReplaceTempView("no_lines")
    assert spark.sql("SELECT * FROM chunk_lines(TABLE(no_lines) PARTITION BY (k) ORDER BY (n), 'lines', 3)").count() == 0
    with pytest.raises(Exception, match="no chunk strategy"):
        chunks("pages", 3)


def test_sources_go_to_the_parser_in_batches(spark):
    """A few rows a source: a batch of their own for each cost more than parsing."""
    table_functions.register(spark)
    d = spark.createDataFrame([(1, "class A:\n    def f(self, b: B):\n        c = A()\n"), (2, None), (3, "def broken(:\n    pass\n"), (4, "x = 1"), (5, "@d\ndef g(): pass")], "id int, t string")
    d.repartition(1).createOrReplaceTempView("some_sources")
    items = spark.sql("SELECT id, i.* FROM some_sources, LATERAL parse_items('python', t) i")
    kinds = spark.sql("SELECT id, b.* FROM some_sources, LATERAL type_bindings('py', t) b")
    assert sorted(tuple(r) for r in items.collect()) == [(1, 0, "class", "A", 3, 1), (1, 1, "fn", "f", 2, 2), (3, 0, "fn", "broken", 2, 1), (5, 0, "fn", "g", 2, 1)]
    assert sorted(tuple(r) for r in kinds.collect()) == [(1, "f", "b", "B"), (1, "f", "c", "A"), (1, "f", "self", "A")]
    for q in (items, kinds):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython " in plan and "UDTF" not in plan
    assert [r[0] for r in spark.sql("SELECT id FROM some_sources LEFT JOIN LATERAL parse_items('python', t) i ON true WHERE i.n IS NULL ORDER BY id").collect()] == [2, 4]
    assert spark.sql("SELECT name FROM parse_items('python', 'def f(): pass')").collect()[0][0] == "f"
