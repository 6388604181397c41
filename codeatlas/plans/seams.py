"""Queries in SQL over registered table functions: chunkers, parsers and type resolvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.functions import table_functions
from codeatlas.plans.registry import _t, query


def _order_files(spark, sf_dir) -> None:
    """View order_files (key, text): each order as a Python source, its lines as methods that take the
    part and call the supplier. An order has few lines."""
    item = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # parsing costs far more than its bytes tell, so partitions must not be merged by size; grouping uses them as they are
    item = item.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    line = F.format_string("    def line%d(self, part: Part%d):\n        ship = Order%d(part)\n        supplier%d(ship)\n", "l_linenumber", "l_partkey", "l_orderkey", "l_suppkey")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda s: s["t"]), "")
    files = item.groupBy("l_orderkey").agg(body.alias("body"))
    files.select(F.col("l_orderkey").alias("key"), F.concat(F.format_string("class Order%d:\n", "l_orderkey"), "body").alias("text")).createOrReplaceTempView("order_files")


@query("""
WITH i AS (SELECT l_orderkey AS key, count(*) AS m FROM lineitem GROUP BY l_orderkey)
SELECT key, CAST(0 AS INTEGER) AS n, 'class' AS label, 'Order' || key AS name, CAST(1 + 3 * m AS INTEGER) AS lines, CAST(1 AS INTEGER) AS depth FROM i
UNION ALL SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER), 'fn', 'line' || l_linenumber, CAST(3 AS INTEGER), CAST(2 AS INTEGER) FROM lineitem""")
def sql_parse_items(spark, sf_dir):
    """Symbols of a source for each order, by a lateral join with the parser."""
    table_functions.register(spark)
    _order_files(spark, sf_dir)
    return spark.sql("SELECT f.key, i.n, i.label, i.name, i.lines, i.depth FROM order_files f, LATERAL parse_items('python', f.text) i")


@query("""
SELECT l_orderkey AS key, 'line' || l_linenumber AS function, unnest(['part', 'self', 'ship']) AS variable, unnest(['Part' || l_partkey, 'Order' || l_orderkey, 'Order' || l_orderkey]) AS class FROM lineitem""")
def sql_type_bindings(spark, sf_dir):
    """Classes of the variables in each method of a source for each order: an annotation, the
    enclosing class and a constructor."""
    table_functions.register(spark)
    _order_files(spark, sf_dir)
    return spark.sql("SELECT f.key, b.function, b.variable, b.class FROM order_files f, LATERAL type_bindings('py', f.text) b")


@query("""
WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn, count(*) OVER (PARTITION BY conv_id) AS m, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi, role FROM conversations),
h AS (SELECT key, lo, hi, turn, role, role = 'user' AS head, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY key) AS h0 FROM l),
c AS (SELECT key, hi, turn, CASE WHEN head THEN role END AS label FROM h WHERE turn = lo OR (head AND turn > h0)),
e AS (SELECT key, turn AS start_line, coalesce(lead(turn) OVER (PARTITION BY key ORDER BY turn), hi + 1) AS end_line, label FROM c)
SELECT key, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, coalesce(label, (start_line + 1) || chr(8211) || end_line) AS label FROM e""")
def sql_chunk_lines(spark, sf_dir):
    """Heading chunks of conversations, a turn a line, each turn of a user a heading, by a table
    function over the partitions of a table."""
    table_functions.register(spark)
    said = F.when(F.col("role") == "user", F.concat(F.lit("# "), F.col("role"))).otherwise(F.col("role"))
    _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("long").alias("line_no"), said.alias("text")).createOrReplaceTempView("turn_lines")
    return spark.sql("SELECT * FROM chunk_lines(TABLE(turn_lines) PARTITION BY (key) ORDER BY (line_no), 'headings', 60)")
