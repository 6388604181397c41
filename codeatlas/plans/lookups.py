"""Queries of lookups that read part of an index: enclosing intervals, one function's callers, hit tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.operators import call_index, calls, chunks, grid, intervals, name_index, sections
from codeatlas.plans.lineage import shared_dir
from codeatlas.plans.registry import _t, query
from codeatlas.streaming import rollups

# -- enclosing intervals --------------------------------------------------------------------

_SPANS_SQL = """d AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS m FROM d),
l AS (SELECT doc_id, i, m, strlen(line) AS size, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - strlen(line) - 1 AS a FROM s),
e AS (SELECT doc_id, i, a, a + size + CAST(i < m AS INTEGER) AS b FROM l WHERE i < m OR size > 0),
v AS (SELECT doc_id, 'doc' AS id, CAST(0 AS BIGINT) AS a, n AS b FROM d UNION ALL SELECT doc_id, 'line ' || i, a, b FROM e
  UNION ALL SELECT doc_id, 'part ' || ((i - 1) // 8), min(a), max(b) FROM e GROUP BY doc_id, (i - 1) // 8
  UNION ALL SELECT doc_id, 'half ' || i, a + (b - a) // 2, b FROM e)"""


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as nested intervals (whole, parts of eight lines, lines, their second halves), and the texts."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    lines = chunks.line_rows(d, "doc_id", "text").select("doc_id", F.col("line_no").alias("i"), F.col("start_byte").cast("long").alias("a"), F.col("end_byte").cast("long").alias("b"))
    whole = d.select("doc_id", F.lit("doc").alias("id"), F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b"))
    named = lambda kind, i: F.concat(F.lit(f"{kind} "), i.cast("string")).alias("id")
    each = lines.select("doc_id", named("line", F.col("i") + 1), "a", "b")
    half = lines.select("doc_id", named("half", F.col("i") + 1), (F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).alias("a"), "b")
    part = lines.groupBy("doc_id", F.floor(F.col("i") / 8).alias("p")).agg(F.min("a").alias("a"), F.max("b").alias("b")).select("doc_id", named("part", F.col("p")), "a", "b")
    return whole.unionByName(each).unionByName(part).unionByName(half), d


@query(f"""
WITH {_SPANS_SQL}, p AS (SELECT doc_id, unnest(range(0, n + 50, 97)) AS at FROM d)
SELECT p.doc_id, p.at, arg_max(v.id, (v.a, -v.b, v.id)) AS inner_id FROM p LEFT JOIN v ON p.doc_id = v.doc_id AND v.a <= p.at AND p.at < v.b GROUP BY ALL""")
def enclosing_span(spark, sf_dir):
    """The innermost of the intervals around every 97th place of each document."""
    spans, d = _spans(spark, sf_dir)
    places = F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long") + 49, F.lit(97).cast("long"))
    points = d.select("doc_id", F.explode(places).alias("at")).withColumn("id", F.col("at").cast("string"))
    found = intervals.innermost(points, spans, "doc_id", "at", "id", "a", "b")
    return found.select("doc_id", "at", F.col("inner").alias("inner_id"))


@query(f"""
WITH {_SPANS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, id) AS k FROM v)
SELECT x.doc_id, x.id, arg_max(y.id, y.k) AS parent FROM o x LEFT JOIN o y ON x.doc_id = y.doc_id AND y.k < x.k AND y.b >= x.b GROUP BY ALL""")
def enclosing_parent(spark, sf_dir):
    """The interval around each interval of a document."""
    spans, _ = _spans(spark, sf_dir)
    return intervals.parents(spans, "doc_id", "id", "a", "b").select("doc_id", "id", "parent")


# -- one function's callers and callees -----------------------------------------------------

_WORDS_SQL = """c AS (SELECT caller, name, min(site) AS site FROM (
  SELECT 'f/' || conv_id || '::t' || turn AS caller, unnest(string_split(text, ' ')) AS name, generate_subscripts(string_split(text, ' '), 1) AS site FROM conversations) GROUP BY caller, name),
f AS (SELECT DISTINCT 'w/' || length(name) || '::' || name AS path, name FROM c),
z AS (SELECT path, name FROM f JOIN (SELECT name, count(*) AS n FROM c GROUP BY name) USING (name) ORDER BY n DESC, name LIMIT 2),
t AS (SELECT min(caller) AS caller FROM c)"""


@query(f"""
WITH {_WORDS_SQL}
SELECT caller AS center, 'callee' AS direction, path AS target, c.name AS raw_name, site FROM c JOIN t USING (caller) JOIN f ON c.name = f.name
UNION ALL SELECT DISTINCT z.path, 'caller', caller, NULL, NULL FROM z JOIN c ON c.name = z.name WHERE caller <> z.path""")
def call_lookup(spark, sf_dir):
    """Callers of the two most called functions and callees of one caller, from an index in buckets."""
    c = _t(spark, sf_dir, "conversations").select(F.concat(F.lit("f/"), F.col("conv_id").cast("string"), F.lit("::t"), F.col("turn").cast("string")).alias("caller"), F.posexplode(F.split("text", " ")).alias("site", "name"))
    c = calls.distinct_calls(c.select("caller", "name", (F.col("site") + 1).cast("long").alias("site"), F.lit(None).cast("string").alias("receiver")))
    path = F.concat(F.lit("w/"), F.char_length("name").cast("string"), F.lit("::"), F.col("name"))
    functions = c.select("name").distinct().select(path.alias("path"), "name")
    index = call_index.build(c, functions)
    made = index.table("calls")
    top = made.groupBy(F.col("simple").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(2).select(path.alias("path"), "name").collect()
    one = made.agg(F.min("caller").alias("caller")).first()["caller"]
    none = F.lit(None)
    out = call_index.callees(index, [one] if one else []).select("center", F.lit("callee").alias("direction"), "target", "raw_name", "site")
    back = call_index.callers(index, {r["path"]: r["name"] for r in top}).select("center", F.lit("caller").alias("direction"), "target", none.cast("string").alias("raw_name"), none.cast("long").alias("site"))
    return out.unionByName(back)


# -- rectangles of all sizes ----------------------------------------------------------------

_SIDE_SQL = "CASE WHEN p_partkey % 1000 = 0 THEN 1000.0 WHEN p_partkey % 100 = 0 THEN 100.0 WHEN p_partkey % 10 = 0 THEN 10.0 ELSE [1.0, 0.1, 0.01, 0.001][CAST(p_partkey % 4 AS INTEGER) + 1] END"
_SIZES_SQL = f"""r AS (SELECT p_partkey AS id, p_size % 3 AS depth, p_partkey AS pre, (p_partkey // 1000) * 10000 + CAST((p_partkey * 7919) % 100003 AS DOUBLE) / 100 AS x, CAST((p_partkey * 104729) % 99991 AS DOUBLE) / 100 AS y,
  {_SIDE_SQL} * (1 + p_size % 5) AS w, {_SIDE_SQL} * (1 + p_size % 4) AS h FROM part)"""


def _sizes(spark, sf_dir) -> DataFrame:
    """Parts as rectangles whose sides differ by six powers of ten, a thousand on each of a row of pages."""
    k, s = F.col("p_partkey"), F.col("p_size")
    small = F.get(F.array(*map(F.lit, (1.0, 0.1, 0.01, 0.001))), (k % 4).cast("int"))
    side = F.when(k % 1000 == 0, 1000.0).when(k % 100 == 0, 100.0).when(k % 10 == 0, 10.0).otherwise(small)
    at = lambda n, m: ((k * n) % m).cast("double") / 100
    return _t(spark, sf_dir, "part").select(k.alias("id"), (s % 3).alias("depth"), k.alias("pre"), (F.floor(k / 1000) * 10000 + at(7919, 100003)).alias("x"), at(104729, 99991).alias("y"), (side * (1 + s % 5)).alias("w"), (side * (1 + s % 4)).alias("h"))


@query(f"""
WITH {_SIZES_SQL}, q AS (SELECT o_orderkey AS point, (o_orderkey // 7500) * 10000 + CAST((o_orderkey * 31) % 100003 AS DOUBLE) / 100 AS px, CAST((o_orderkey * 17) % 99991 AS DOUBLE) / 100 AS py FROM orders)
SELECT point, max(r.id) AS id FROM q LEFT JOIN r ON x <= px AND px < x + w AND y <= py AND py < y + h GROUP BY point""")
def point_hits(spark, sf_dir):
    """The deepest rectangle under each of many points."""
    k = F.col("o_orderkey")
    at = lambda n, m: ((k * n) % m).cast("double") / 100
    points = _t(spark, sf_dir, "orders").select(k.alias("point"), (F.floor(k / 7500) * 10000 + at(31, 100003)).alias("px"), at(17, 99991).alias("py"))
    return grid.hit_tests(points, _sizes(spark, sf_dir))


@query(f"""
WITH {_SIZES_SQL}, p AS (SELECT a.id AS id, b.id AS nb, row_number() OVER (PARTITION BY a.id ORDER BY b.y - (a.y + a.h), abs(b.x + b.w / 2 - (a.x + a.w / 2)), b.id) AS k
  FROM r a JOIN r b ON a.depth = b.depth AND a.id <> b.id AND b.x < a.x + a.w AND b.x + b.w > a.x AND b.y - (a.y + a.h) >= 0)
SELECT id, nb AS neighbour FROM p WHERE k = 1""")
def grid_step(spark, sf_dir):
    """The nearest rectangle below each one, whatever their sizes."""
    return grid.neighbours(_sizes(spark, sf_dir), "down")


# -- names by length ------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(lower(c_name), '7.*0.*5') ORDER BY strlen(c_name), c_name, c_custkey LIMIT 12")
def indexed_search(spark, sf_dir):
    """The twelve best names for a query, from an index that is read shortest names first."""
    index = name_index.build(_t(spark, sf_dir, "customer"), "c_name", "c_custkey")
    return name_index.search(index, "705").select(F.col("order").alias("c_custkey"), F.col("name").alias("c_name"))


# -- rollups that follow changes ------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, CAST(sum(round(o_totalprice)) AS BIGINT) AS lines FROM orders GROUP BY 1),
f AS (SELECT 'n' || c_nationkey || '/' || c_mktsegment AS folder, 'n' || c_nationkey AS top, coalesce(lines, c_custkey) AS lines, coalesce(n, 0) AS commits FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_acctbal >= 0),
a AS (SELECT folder, lines, commits FROM f UNION ALL SELECT top, lines, commits FROM f UNION ALL SELECT '', lines, commits FROM f)
SELECT folder, count(*) AS n_files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(commits) AS BIGINT) AS commits FROM a GROUP BY folder""")
def maintained_rollup(spark, sf_dir):
    """Totals of customers as files by nation and segment, after two change sets: what they ordered, and
    those in debt, who go."""
    c, long = _t(spark, sf_dir, "customer"), lambda x: F.lit(x).cast("long")
    path = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string")).alias("path")
    store = rollups.Store(spark, f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")
    store.apply(c.select(path, F.col("c_custkey").cast("long").alias("lines"), long(0).alias("commits")))
    made = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round("o_totalprice")).cast("long").alias("lines"), F.count("*").alias("commits"))
    store.apply(c.join(made, "c_custkey").select(path, "lines", "commits"))
    store.apply(c.where("c_acctbal < 0").select(path, long(None).alias("lines"), long(None).alias("commits")))
    return store.folders()


# -- texts larger than a task ---------------------------------------------------------------


@query("""
WITH RECURSIVE l AS (SELECT o_orderpriority AS k, o_orderkey AS pos, o_custkey % 37 = 0 AS head, o_custkey % 5 = 1 AS blank, '## ' || o_custkey AS said FROM orders),
w AS (SELECT k, min(pos) AS a, max(pos) + 1 AS z, min(CASE WHEN head THEN pos END) AS h0 FROM l GROUP BY k),
e AS (SELECT k, pos, head FROM l JOIN w USING (k) WHERE pos > a AND (head OR blank) AND NOT (head AND pos = h0)),
j AS (SELECT k, pos, min(CASE WHEN head THEN pos END) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS h,
  min(pos) OVER (PARTITION BY k ORDER BY pos RANGE BETWEEN 60 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM (SELECT k, pos, head FROM e UNION ALL SELECT k, a, false FROM w)),
c AS (SELECT k, a AS pos FROM w UNION ALL SELECT c.k, least(j.h, j.b) FROM c JOIN j ON c.k = j.k AND c.pos = j.pos WHERE least(j.h, j.b) IS NOT NULL),
x AS (SELECT k, pos, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS z FROM c)
SELECT x.k AS o_orderpriority, x.pos AS start_line, coalesce(x.z, w.z) AS end_line, CASE WHEN l.head THEN CAST(substr(l.said, 4) AS VARCHAR) ELSE (x.pos + 1) || chr(8211) || coalesce(x.z, w.z) END AS label
FROM x JOIN w ON x.k = w.k JOIN l ON x.k = l.k AND x.pos = l.pos""")
def order_sections(spark, sf_dir):
    """Heading chunks of five texts, each all orders of a priority: an order a line, some of them headings
    or blank. A text's lines are cut into ranges, and ranges run beside each other."""
    o = _t(spark, sf_dir, "orders")
    said = F.when(F.col("o_custkey") % 37 == 0, F.concat(F.lit("## "), F.col("o_custkey").cast("string"))).when(F.col("o_custkey") % 5 == 1, F.lit(" ")).otherwise(F.col("o_orderstatus"))
    return sections.headings(o.select("o_orderpriority", "o_orderkey", said.alias("s")), "o_orderpriority", "o_orderkey", "s")
