"""Queries of parsing, navigation, display, highlighting and drafts, with SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas import api
from codeatlas.functions import display, paths, tables
from codeatlas.operators import cache, calls, chunks, hierarchy, highlight, navigation, nested, pack
from codeatlas.plans.lineage import shared_dir
from codeatlas.plans.registry import _BYTES_SQL, _PATH_SQL, _t, _urls, query
from codeatlas.plans.sources import EXTENSIONS, SOURCES
from codeatlas.streaming import events as streams

# -- parsing --------------------------------------------------------------------------------

_LANGS = list(SOURCES)


def _files(spark, sf_dir) -> DataFrame:
    """(key, language, ext, text): a small source for each part, the languages in turn."""
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(_LANGS)).cast("int"))
    # a small file is one task, and parsing costs far more than its bytes tell
    parts = _t(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(k.alias("key"), pick(_LANGS).alias("language"), pick([EXTENSIONS[x] for x in _LANGS]).alias("ext"), F.replace(pick([SOURCES[x][0] for x in _LANGS]), F.lit("%"), k.cast("string")).alias("text"))


def _values(rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


_ITEM_ROWS = [(i, n, *item) for i, x in enumerate(_LANGS) for n, item in enumerate(SOURCES[x][1])]
_CALL_ROWS = [(i, *c) for i, x in enumerate(_LANGS) for c in SOURCES[x][2]]


@query(f"""
SELECT p_partkey AS key, lang AS language, CAST(n AS INTEGER) AS n, label, replace(name, '%', CAST(p_partkey AS VARCHAR)) AS name, CAST(lines AS INTEGER) AS lines, CAST(depth AS INTEGER) AS depth
FROM part JOIN (VALUES {_values(_ITEM_ROWS)}) v(i, n, label, name, lines, depth) ON p_partkey % {len(_LANGS)} = i JOIN (VALUES {_values(list(enumerate(_LANGS)))}) w(j, lang) ON i = j""")
def parse_items(spark, sf_dir):
    """Symbols of sources in ten languages, each file parsed once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeatlas.parse import registry, rows

        for d in it:
            out = []
            for key, language, text in d.itertuples(index=False):
                source, found = text.encode(), []

                def add(items, depth: int, source: bytes = source, found: list = found) -> None:
                    for i in items:
                        found.append((i.label, i.name, rows(source, i.start, i.end), depth))
                        add(i.children, depth + 1)

                add(registry.parse(source, language), 1)
                out += [(key, language, n, *x) for n, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["key", "language", "n", "label", "name", "lines", "depth"])

    return _files(spark, sf_dir).select("key", "language", "text").mapInPandas(run, "key long, language string, n int, label string, name string, lines int, depth int")


@query(f"""
SELECT p_partkey AS key, replace(name, '%', CAST(p_partkey AS VARCHAR)) AS name, receiver FROM part JOIN (VALUES {_values(_CALL_ROWS)}) v(i, name, receiver) ON p_partkey % {len(_LANGS)} = i""")
def source_calls(spark, sf_dir):
    """Calls of each source's last function, with the name before the dot."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeatlas.parse import registry

        for d in it:
            out = []
            for key, language, ext, text in d.itertuples(index=False):
                source = text.encode()
                functions, todo = [], registry.parse(source, language)
                while todo:
                    todo = [*(i := todo[0]).children, *todo[1:]]
                    functions += [i] if i.label == "fn" else []
                out += [(key, n, r) for n, _, _, r in (registry.calls(source, ext, functions[-1].start, functions[-1].end) if functions else [])]
            yield pd.DataFrame(out, columns=["key", "name", "receiver"])

    return _files(spark, sf_dir).select("key", "language", "ext", "text").mapInPandas(run, "key long, name string, receiver string")


@query("""
WITH f AS (SELECT p_brand, p_partkey, split_part(p_name, ' ', 2) AS word, p_size FROM part), c AS (SELECT DISTINCT word FROM f WHERE p_size % 2 = 0)
SELECT word AS name, count(*) AS n_functions, count(DISTINCT p_brand) AS n_files FROM f SEMI JOIN c USING (word) GROUP BY word""")
def class_names(spark, sf_dir):
    """Files that hold the name of a class: a semi-join with the distinct names."""
    f = _t(spark, sf_dir, "part").select("p_brand", F.split("p_name", " ")[1].alias("name"), "p_size")
    classes = f.where("p_size % 2 = 0").select("name").distinct()
    return f.join(classes, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n_functions"), F.count_distinct("p_brand").alias("n_files"))


# -- highlighting ---------------------------------------------------------------------------

_NAMES = ["keyword.control", "punctuation", "string.special", "text.title", "text.uri", "function.method", "number", "variable", "comment"]
_KINDS = {"keyword.control": "Keyword", "string.special": "String", "text.title": "Type", "text.uri": "Property", "function.method": "Function", "number": "Number", "comment": "Comment"}
_KIND_SQL = "CASE capture " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_NAME_SQL = "list_extract([" + ", ".join(f"'{n}'" for n in _NAMES) + "], CAST({} AS INTEGER) + 1)"
_SPANS_SQL = f"""{_BYTES_SQL}, i AS (SELECT doc_id, unnest(range(0, strlen(text), 100)) AS a, strlen(text) AS n FROM documents WHERE text <> ''),
o AS (SELECT doc_id, a, least(a + 90, n) AS b, {_NAME_SQL.format("(a // 100) % 9")} AS capture FROM i),
x AS (SELECT *, {_KIND_SQL} AS kind FROM o),
y AS (SELECT doc_id, a, b, kind FROM x WHERE kind IS NOT NULL UNION ALL SELECT doc_id, a + 20, least(a + 50, b), 'Number' FROM x WHERE kind IS NULL AND b > a + 20),
z AS (SELECT doc_id, line_no, greatest(a, s0) - s0 AS s, least(b, e0) - s0 AS e, kind, e0 - s0 AS size FROM y JOIN q USING (doc_id) WHERE a < e0 AND b > s0)"""


def _captures(spark, sf_dir) -> DataFrame:
    """From every hundredth byte on a capture of 90 bytes, and within it one of 30."""
    d = _t(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(100).cast("long"))).alias("start"))
    outer = d.select("doc_id", "start", F.least(F.col("start") + 90, "n").alias("end"), F.get(F.array(*map(F.lit, _NAMES)), (F.floor(F.col("start") / 100) % 9).cast("int")).alias("capture"))
    inner = outer.where("end > start + 20").select("doc_id", (F.col("start") + 20).alias("start"), F.least(F.col("start") + 50, F.col("end")).alias("end"), F.lit("number").alias("capture"))
    return outer.unionByName(inner)


def _lines(spark, sf_dir) -> DataFrame:
    return chunks.line_rows(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_SPANS_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, string_agg(s || '-' || e || ':' || kind, ',' ORDER BY s) AS spans FROM z GROUP BY doc_id, line_no")
def highlight_lines(spark, sf_dir):
    """Spans of every line; of overlapping ones the outer, unless its capture has no kind."""
    found = highlight.line_spans(_captures(spark, sf_dir), _lines(spark, sf_dir), "doc_id")
    said = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["kind"])
    return found.select("doc_id", "line_no", F.array_join(F.transform("spans", said), ",").alias("spans"))


@query(f"""
WITH {_SPANS_SQL} SELECT kind, CAST(sum(n) AS BIGINT) AS n_bytes FROM (SELECT kind, e - s AS n FROM z UNION ALL
  SELECT 'Default', size - sum(e - s) FROM z GROUP BY doc_id, line_no, size) GROUP BY kind HAVING sum(n) > 0""")
def colour_runs(spark, sf_dir):
    """Runs of one colour that cover each highlighted line, and how much of each there is."""
    found = highlight.line_spans(_captures(spark, sf_dir), _lines(spark, sf_dir), "doc_id").join(_lines(spark, sf_dir), ["doc_id", "line_no"])
    r = found.select(F.explode(highlight.runs(F.col("end_byte") - F.col("start_byte"), F.col("spans"))).alias("r"))
    return r.groupBy("r.kind").agg(F.sum("r.n").alias("n_bytes"))


@query()
def source_highlights(spark, sf_dir):
    """Captures of sources in ten languages by kind, from a scanner."""
    found = highlight.file_captures(_files(spark, sf_dir), "key")
    return found.groupBy("key", highlight.kind_of("capture").alias("kind")).agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query(f"""
WITH {_BYTES_SQL}, c AS (SELECT doc_id AS card, doc_id % 3 AS first_line, 2 + doc_id % 9 AS measure, doc_id FROM documents)
SELECT card, CAST(line_no - first_line AS BIGINT) AS row FROM c JOIN q USING (doc_id) WHERE line_no >= first_line AND line_no < first_line + least(measure, 6)""")
def card_lines(spark, sf_dir):
    """The first lines that each card shows."""
    cards = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("card"), (F.col("doc_id") % 3).alias("first_line"), (2 + F.col("doc_id") % 9).alias("measure"), "doc_id")
    return navigation.card_lines(_lines(spark, sf_dir), cards, "doc_id", 6).select("card", "row")


# -- navigation -----------------------------------------------------------------------------

_MOVES = "CASE event_type WHEN 'click' THEN 'back' WHEN 'error' THEN 'forward' ELSE 'push' END"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, {_MOVES} AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS entries, CAST(-1 AS BIGINT) AS cur FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT s.user_id, e.i, CASE WHEN what = 'push' THEN (list_append(entries[1:cur + 1], event_id))[greatest(cur + 2 - 5, 0) + 1:] ELSE entries END,
    CASE what WHEN 'push' THEN least(cur + 2, 5) - 1 WHEN 'back' THEN greatest(cur - 1, least(len(entries) - 1, 0)) ELSE least(cur + 1, len(entries) - 1) END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, array_to_string(entries, ',') AS entries, CAST(cur AS INTEGER) AS cursor FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM s) WHERE k = 1""")
def navigation_history(spark, sf_dir):
    """A history of five entries for each user, after all of the user's moves."""
    what = F.when(F.col("event_type") == "click", "back").when(F.col("event_type") == "error", "forward").otherwise("push")
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), what.alias("what"), "event_id")
    found = navigation.history(e, "user_id", "o", "what", "event_id", 5)
    return found.select("user_id", F.array_join(F.col("entries").cast("array<string>"), ",").alias("entries"), "cursor")


@query("""
SELECT c_custkey, CASE WHEN n > 0 THEN ((sel + d) % n + n) % n ELSE sel END AS moved, least(sel, greatest(n - 1, 0)) AS clamped
FROM (SELECT c_custkey, c_custkey % 11 AS sel, c_custkey % 7 - 3 AS d, c_custkey % 13 AS n FROM customer)""")
def selection_moves(spark, sf_dir):
    """A selection that goes around the ends, and one that a new search cuts."""
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(k, navigation.move_selection(k % 11, k % 7 - 3, k % 13).alias("moved"), navigation.clamp_selection(k % 11, k % 13).alias("clamped"))


_KIND4 = "list_extract(['folder', 'file', 'item', 'chunk'], CAST(p_size % 4 AS INTEGER) + 1)"


def _nodes4(spark, sf_dir) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["folder", "file", "item", "chunk"])), (F.col("p_size") % 4).cast("int"))
    label = F.when(kind == "item", F.when(F.col("p_partkey") % 3 == 0, "struct").otherwise("fn"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), label.alias("label"), F.col("p_name").alias("name"), "p_brand", "p_size", (F.col("p_partkey") % 5).alias("children"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_partkey") * 10).alias("byte_start"))


@query(f"""
WITH k AS (SELECT p_partkey AS id, {_KIND4} AS kind FROM part)
SELECT mode, kind, count(*) AS n FROM (SELECT 'file' AS mode, kind FROM k WHERE kind = 'file' UNION ALL SELECT 'symbol', kind FROM k WHERE kind <> 'folder') GROUP BY mode, kind""")
def palette_candidates(spark, sf_dir):
    """What a search looks through in each of its modes."""
    n = _nodes4(spark, sf_dir)
    both = [navigation.candidates(n, m).groupBy("kind").agg(F.count("*").alias("n")).withColumn("mode", F.lit(m)) for m in ("file", "symbol")]
    return both[0].unionByName(both[1])


@query(f"""
SELECT id, kind = 'item' AND id % 3 <> 0 AND id % 5 = 0 AS enters, id % 6 > 0 AND id % 5 = 0 AND kind <> 'folder' AS page,
  CASE WHEN kind = 'item' THEN 'item:' || CASE WHEN id % 3 = 0 THEN 'struct' ELSE 'fn' END ELSE kind END AS kind_key FROM (SELECT p_partkey AS id, {_KIND4} AS kind FROM part)""")
def node_tests(spark, sf_dir):
    """Which nodes can be the centre of a call graph, which are pages, and their kinds' names."""
    c = F.col
    return _nodes4(spark, sf_dir).select("id", navigation.can_enter_calls(c("kind"), c("label"), c("children")).alias("enters"), navigation.is_page(c("kind"), c("byte_start"), c("children")).alias("page"), display.kind_key("kind", "label").alias("kind_key"))


@query("""
WITH i AS (SELECT l_orderkey, string_agg(l_linenumber * 10 || ':' || l_partkey || '/' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey || '/' || l_linenumber) AS s FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey)
SELECT o_orderkey AS file, coalesce(s, '0:file') AS symbols FROM orders LEFT JOIN i ON l_orderkey = o_orderkey""")
def file_symbols(spark, sf_dir):
    """Items of each file with their first byte; a file without items stands for itself."""
    item = _t(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("file"), F.concat_ws("/", "l_partkey", "l_linenumber").alias("id"), F.lit("item").alias("kind"), (F.col("l_linenumber") * 10).cast("long").alias("byte_start"))
    file = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit("file").alias("id"), F.lit("file").alias("kind"), F.lit(0).cast("long").alias("byte_start"))
    said = F.transform("symbols", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["id"]))
    return navigation.file_symbols(file.unionByName(item)).select("file", F.array_join(said, ",").alias("symbols"))


@query(f"""
WITH p AS (SELECT string_split({_PATH_SQL}, '/') AS parts, strlen(html) AS bytes FROM pages),
f AS (SELECT path, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT unnest(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS path, bytes FROM p) GROUP BY path),
u AS (SELECT path AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS level, string_split(path, '/') AS parts FROM f),
c AS (SELECT p, level, bytes, path AS a FROM u JOIN f ON f.path = array_to_string(parts[1:level], '/')),
g AS (SELECT p, bool_and(a = p OR bytes % 4 > 0) AS shown, list((-bytes, a) ORDER BY level) AS o FROM c GROUP BY p)
SELECT p AS path, row_number() OVER (ORDER BY o) AS place FROM g WHERE shown""")
def unfolded_folders(spark, sf_dir):
    """The list of folders that an unfolded tree shows, in order."""
    f = hierarchy.rollup(_urls(spark, sf_dir), "path", F.sum("bytes").alias("bytes"), root=False)
    shown = navigation.unfolded(f.select(F.col("folder").alias("path"), "bytes", (F.col("bytes") % 4 > 0).alias("expanded")))
    return hierarchy.preorder(shown, "order", "place").select("path", (F.col("place") + 1).cast("long").alias("place"))


@query("""
WITH v AS (SELECT user_id AS parent, max_by(event_id, (ts, event_id)) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT o_custkey AS parent, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS big FROM orders GROUP BY o_custkey)
SELECT c.parent, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.parent AND o_orderkey = v.seen) THEN seen ELSE big END AS child FROM c LEFT JOIN v ON v.parent = c.parent""")
def step_in(spark, sf_dir):
    """The child visited last if it is still there, else the largest."""
    e = _t(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("parent"), F.col("event_id").alias("child"), F.struct("ts", "event_id").alias("o"))
    c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), "o_totalprice", F.col("o_orderkey").alias("place"))
    return navigation.step_in(c, navigation.last_visited(e, "parent", "child", "o"), "parent", "child", "o_totalprice", "place")


@query("""
SELECT n_nationkey, array_to_string(CASE WHEN list_contains(f, n_name) THEN f ELSE list_append(f, n_name) END, ',') AS exact,
  array_to_string(CASE WHEN list_contains(list_transform(f, lambda x: lower(x)), lower(n_name)) THEN f ELSE list_append(f, n_name) END, ',') AS any_case
FROM (SELECT n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN ['a', n_name] WHEN 1 THEN [lower(n_name)] ELSE ['b'] END AS f FROM nation)""")
def add_filters(spark, sf_dir):
    """An entry added to a filter list unless it is there, in any case or as it is."""
    n = F.col("n_name")
    f = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("a"), n)).when(F.col("n_nationkey") % 3 == 1, F.array(F.lower(n))).otherwise(F.array(F.lit("b")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(navigation.add_absent(f, n), ",").alias("exact"), F.array_join(navigation.add_absent(f, n, True), ",").alias("any_case"))


# -- caches and loading ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ORDER BY o_totalprice DESC, o_orderkey LIMIT 4")
def disk_loads(spark, sf_dir):
    """The four waiting requests of most area that are not on their way."""
    busy = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return cache.next_loads(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), busy, "o_totalprice", "o_orderkey")


@query("""
WITH RECURSIVE e AS (SELECT o_custkey AS u, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS area, o_orderpriority AS g FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY area DESC, k) AS n FROM e),
m AS (SELECT *, CASE WHEN area <= 0 THEN n ELSE min(n) OVER (PARTITION BY u, g, area <= 0) END AS lead FROM r)
SELECT u AS o_custkey, k AS o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY lead, n) AS place FROM m) WHERE place <= 4""")
def grouped_requests(spark, sf_dir):
    """Four requests of each customer: the best, then those of its group, then the next."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("area"), "o_orderpriority")
    return cache.grouped_requests(o, "area", "o_orderkey", "o_orderpriority", 4, "o_custkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT user_id, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS entries FROM events GROUP BY user_id")
def cache_bytes(spark, sf_dir):
    """Bytes that each cache holds."""
    return cache.held_bytes(_t(spark, sf_dir, "events").withColumn("b", F.round("value").cast("long")), "b", "user_id")


@query("SELECT o_orderkey AS id, c_custkey AS file, c_name AS fingerprint FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0")
def disk_keys(spark, sf_dir):
    """Nodes of files that have a fingerprint."""
    known = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("fingerprint"))
    return cache.disk_keys(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id")), known)


@query()
def texture_keys(spark, sf_dir):
    """Keys of cached pictures: FNV-1a over fields with their lengths."""
    n, c, z = _nodes4(spark, sf_dir), F.col, F.lit(0).cast("long")
    made = display.texture_key_bytes(F.concat(F.lit("./src\\"), c("p_brand")), c("id"), c("kind"), c("label"), F.concat_ws("::", "p_brand", "name"), (c("id") % 4).cast("int"), z + 7, z - 1)
    return n.select("id", api.content_fingerprint(made).alias("key"))


@query("""
SELECT event_id, CASE phase WHEN 0 THEN 0.0 WHEN 2 THEN 1.0 ELSE CASE WHEN total > 0 THEN done / total ELSE 0.0 END END AS fraction,
  CASE WHEN phase = 0 THEN 'Scanning files…' WHEN phase = 1 AND total > 0 THEN 'Parsing ' || done || '/' || total || ' files…' WHEN phase = 1 THEN 'Parsing…'
    WHEN phase = 2 THEN 'Building symbol tree…' ELSE 'Packing ' || done || '/' || total || ' nodes...' END AS said
FROM (SELECT event_id, event_id % 4 AS phase, event_id % 6 AS total, least(event_id % 6, event_id % 5) AS done FROM events)""")
def load_progress(spark, sf_dir):
    """What a load says of itself at every step."""
    i = F.col("event_id")
    e = _t(spark, sf_dir, "events").select("event_id", (i % 4).alias("phase"), (i % 6).alias("total"), F.least(i % 6, i % 5).alias("done"))
    return streams.loading(e).select("event_id", "fraction", "said")


@query("SELECT event_id, user_id FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id // 1000 DESC) AS k FROM events) WHERE k = 1")
def current_events(spark, sf_dir):
    """Events of the newest generation of each load."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 1000).alias("generation"))
    return streams.current(e, "generation", "user_id").select("event_id", "user_id")


# -- display --------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CAST(b AS INTEGER) AS budget, CASE WHEN b = 0 THEN NULL WHEN length(p_name) <= b THEN p_name ELSE substr(p_name, 1, CAST(b - 1 AS BIGINT)) || '…' END AS shown
FROM (SELECT *, CASE WHEN floor((p_size * 3.0 - 12.0) / (12.0 * 0.62) + 1e-6) < 2 THEN 0 ELSE floor((p_size * 3.0 - 12.0) / (12.0 * 0.62) + 1e-6) END AS b FROM part)""")
def truncated_names(spark, sf_dir):
    """Names as far as a box has room for them."""
    p = _t(spark, sf_dir, "part").withColumn("w", F.col("p_size") * 3.0)
    return p.select("p_partkey", display.char_budget("w", 12.0).alias("budget"), display.truncate("p_name", "w", 12.0).alias("shown"))


@query()
def wrapped_docs(spark, sf_dir):
    """Every document's paragraphs wrapped to forty characters: rows and the longest."""
    d = _t(spark, sf_dir, "documents").select("doc_id", display.wrap_doc(F.col("text"), F.lit(40)).alias("rows"))
    return d.select("doc_id", F.size("rows").alias("n_rows"), F.coalesce(F.array_max(F.transform("rows", F.char_length)), F.lit(0)).alias("longest"))


@query("""
SELECT o_orderkey, CAST(b // 1073741824 AS VARCHAR) || CASE WHEN b % 1073741824 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(CAST(b % 1073741824 AS HUGEINT) * CAST(931322574615478515625 AS HUGEINT) AS VARCHAR), 30, '0'), '0') END AS gib, CASE WHEN b > 0 THEN b END AS bytes
FROM (SELECT o_orderkey, o_orderkey * 268435456 + o_orderkey % 3 AS b FROM orders)""")
def gib_sizes(spark, sf_dir):
    """Exact sizes in GiB, and the bytes that they are read back as."""
    b = F.col("o_orderkey") * (1 << 28) + F.col("o_orderkey") % 3
    d = _t(spark, sf_dir, "orders").select("o_orderkey", display.format_gibibytes(b).alias("gib"))
    return d.select("o_orderkey", "gib", display.parse_gibibytes("gib")["bytes"].alias("bytes"))


@query("""
SELECT p_partkey, p_size || ' · p' || p || ' · ' || p_partkey % 90 || 'L' AS card, p_partkey % 90 || 'L · ' || p_size || ' commits · p' || p AS readout, p_size || CASE WHEN p_size = 1 THEN ' file' ELSE ' files' END AS files
FROM (SELECT *, CAST(round_even((p_partkey % 8) / 8.0 * 100, 0) AS BIGINT) AS p FROM part)""")
def card_texts(spark, sf_dir):
    """What a card says of changes and size."""
    p = _t(spark, sf_dir, "part").withColumns({"churn": (F.col("p_partkey") % 8) / F.lit(8.0), "lines": F.col("p_partkey") % 90})
    return p.select("p_partkey", display.card_meta("p_size", "churn", "lines").alias("card"), display.churn_readout("p_size", "churn", "lines").alias("readout"), display.plural("p_size", "file").alias("files"))


def _mix_sql(a: str, b: str, t: str) -> str:
    part = lambda s: f"(CAST(floor(CAST((({a}) >> {s}) & 255 AS FLOAT) + (CAST((({b}) >> {s}) & 255 AS FLOAT) - CAST((({a}) >> {s}) & 255 AS FLOAT)) * CAST({t} AS FLOAT) + 0.5) AS BIGINT) & 255)"
    return f"(({part(16)} << 16) | ({part(8)} << 8) | {part(0)})"


@query(f"""
WITH d AS (SELECT p_partkey, p_size, {_mix_sql(str(tables.DEPTH_FILL[0]), str(tables.DEPTH_FILL[1]), "least(p_size % 11, 8) / 8.0")} AS depth FROM part),
f AS (SELECT *, {_mix_sql("depth", str(tables.FILE_TINT), str(tables.FILE_BLEND))} AS file FROM d), x AS (SELECT *, {_mix_sql("file", str(0xC06030), "0.35")} AS rust FROM f)
SELECT p_partkey, CAST({_mix_sql(str(tables.HEAT[0]), str(tables.HEAT[1]), "(p_partkey % 16) / 16.0")} AS INTEGER) AS heat, CAST(depth AS INTEGER) AS folder, CAST(rust AS INTEGER) AS file, CAST({_mix_sql("rust", str(0xFFFFFF), "0.12")} AS INTEGER) AS border FROM x""")
def box_colours(spark, sf_dir):
    """Colours of change, of folders by depth, of files by type, and of borders."""
    level = F.col("p_size") % 11
    p = _t(spark, sf_dir, "part").select("p_partkey", display.churn_heat((F.col("p_partkey") % 16) / F.lit(16.0)).alias("heat"), display.box_fill(F.lit("Folder"), level, F.lit("a/b"), F.lit("b")).alias("folder"), display.box_fill(F.lit("File"), level, F.lit("a/b.rs"), F.lit("b.rs")).alias("file"))
    return p.withColumn("border", display.border("file"))


@query("""
SELECT id, x + w / 2 AS cx, y + h / 2 AS cy, least(greatest(0.5 * least(1600.0 / w, 900.0 / h), 0.05), 8.0) AS zoom, least(greatest(longest * 12.0 * 0.62 + 12.0, 640.0), 1280.0) AS width
FROM (SELECT p_partkey AS id, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(8 + p_size * 40 AS DOUBLE) AS w, CAST(6 + p_size * p_size AS DOUBLE) AS h, p_partkey % 200 AS longest FROM part)""")
def camera_frames(spark, sf_dir):
    """The camera that shows each rectangle, and the width of a focused page."""
    d = lambda c: c.cast("double")
    s = F.col("p_size")
    cx, cy, zoom = display.frame(d(F.col("p_partkey") % 40), d(s), d(8 + s * 40), d(6 + s * s), 1600.0, 900.0, 0.5, 0.05, 8.0)
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cx.alias("cx"), cy.alias("cy"), zoom.alias("zoom"), display.focused_width(F.col("p_partkey") % 200).alias("width"))


# -- drafts ---------------------------------------------------------------------------------


def _tree(spark, sf_dir) -> DataFrame:
    """Brands as folders of parts, with preorder numbers: the root, then each brand and its parts."""
    from pyspark.sql import Window

    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    none = F.lit(None).cast("string")
    files = p.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("parent_id"), F.lit("file").alias("kind"), F.col("p_size").cast("long").alias("measure"), F.lit(2).alias("depth"), F.array(F.lit("root"), F.col("p_brand")).alias("anc"), F.struct(F.col("p_brand").alias("a"), F.col("p_partkey").alias("b")).alias("o"), none.alias("own_role"))
    brands = p.groupBy("p_brand").agg(F.sum("p_size").cast("long").alias("measure"))
    folders = brands.select(F.col("p_brand").alias("id"), F.lit("root").alias("parent_id"), F.lit("folder").alias("kind"), "measure", F.lit(1).alias("depth"), F.array(F.lit("root")).alias("anc"), F.struct(F.col("p_brand").alias("a"), F.lit(-1).cast("long").alias("b")).alias("o"), F.when(F.col("p_brand").endswith("1"), "Test").alias("own_role"))
    top = spark.range(1).select(F.lit("root").alias("id"), none.alias("parent_id"), F.lit("folder").alias("kind"), F.lit(0).cast("long").alias("measure"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("anc"), F.struct(F.lit("").alias("a"), F.lit(-1).cast("long").alias("b")).alias("o"), none.alias("own_role"))
    nodes = files.unionByName(folders).unionByName(top)
    # numbers by parent: a brand's first is what the brands before it hold
    starts = brands.select(F.col("p_brand").alias("a")).join(p.groupBy(F.col("p_brand").alias("a")).agg(F.count("*").alias("n")), "a")
    starts = starts.withColumn("first", 1 + F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each brand
    own = F.row_number().over(Window.partitionBy("o.a").orderBy("o.b")) - 1
    nodes = nodes.withColumn("own", own).join(starts.select(F.col("a").alias("_a"), "first"), F.col("o.a") == F.col("_a"), "left")
    return nodes.withColumn("pre", (F.coalesce("first", F.lit(0)) + F.col("own")).cast("long")).select("id", "parent_id", "kind", F.lit(None).cast("string").alias("label"), F.col("id").alias("path"), F.col("id").alias("name"), F.lit(0).alias("ordinal"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("byte_start"), "measure", "depth", "anc", "pre", "own_role")


_LEAF_SQL = "(20.8 + (1 + p_size) * 15.6 + 6.0)"


@query(f"""
WITH f AS (SELECT p_brand, p_partkey, {_LEAF_SQL} AS h, 28.8 + coalesce(sum({_LEAF_SQL} + 8.0) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy FROM part),
b AS (SELECT p_brand, 28.8 + sum(h + 8.0) AS h FROM f GROUP BY p_brand),
g AS (SELECT *, 28.8 + coalesce(sum(h + 8.0) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy FROM b)
SELECT id, CAST(round(x, 3) AS DOUBLE) AS x, CAST(round(y, 3) AS DOUBLE) AS y, CAST(round(w, 3) AS DOUBLE) AS w, CAST(round(h, 3) AS DOUBLE) AS h FROM (
  SELECT p_brand || '/' || p_partkey AS id, 16.0 AS x, g.dy + f.dy AS y, 640.0 AS w, f.h AS h FROM f JOIN g USING (p_brand) UNION ALL
  SELECT p_brand, 8.0, dy, 656.0, h FROM g UNION ALL SELECT 'root', 0.0, 0.0, 672.0, 28.8 + sum(h + 8.0) FROM g)""")
def draft_layout(spark, sf_dir):
    """Stacks of every folder, of any depth."""
    r = pack.draft(_tree(spark, sf_dir), max_depth=2)
    return r.select("id", *(F.round(c, 3).alias(c) for c in "xywh"))


@query("""
WITH n AS (SELECT p_brand || '/' || p_partkey AS id, p_brand AS a, 0 AS last, p_partkey AS k, CASE WHEN ends_with(p_brand, '1') THEN 'Test' ELSE 'Source' END AS inherited FROM part UNION ALL
  SELECT DISTINCT p_brand, p_brand, 1, 0, CASE WHEN ends_with(p_brand, '1') THEN 'Test' ELSE 'Source' END FROM part UNION ALL SELECT 'root', '~', 2, 0, 'Source')
SELECT id, row_number() OVER (ORDER BY a, last, k) - 1 AS post, inherited FROM n""")
def post_order(spark, sf_dir):
    """The order in which a layout is worked off, and the role that each node inherits."""
    return pack.postorder(_tree(spark, sf_dir))


@query()
def progressive_layout(spark, sf_dir):
    """Snapshots of a layout on its way: rectangles at each, and how far they reach."""
    nodes = _tree(spark, sf_dir)
    r = pack.progressive(nodes, pack.postorder(nodes), 4, max_depth=2)
    return r.groupBy("completed").agg(F.count("*").alias("n"), F.round(F.max(F.col("x") + F.col("w")), 3).alias("right"), F.round(F.max(F.col("y") + F.col("h")), 3).alias("bottom"))


@query("SELECT count(*) AS nodes FROM (SELECT p_partkey FROM part UNION ALL SELECT 0 FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 0)")
def node_count(spark, sf_dir):
    """Nodes of a tree."""
    return _tree(spark, sf_dir).agg(F.count("*").alias("nodes"))


@query("SELECT p_brand || '/' || p_partkey AS id, p_brand AS parent_id, CAST(p_size AS BIGINT) AS measure FROM part UNION ALL SELECT p_brand, 'root', CAST(sum(p_size) AS BIGINT) FROM part GROUP BY p_brand UNION ALL SELECT 'root', NULL, 0")
def tree_json(spark, sf_dir):
    """A tree written as nested JSON, a document for each top folder, and read back."""
    n = _tree(spark, sf_dir).select("id", "parent_id", "kind", "measure", "depth", "anc", "pre")
    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    nested.write(n, folder)
    return nested.read(spark, folder, "id string, kind string, measure long, depth int, pre long").select("id", "parent_id", "measure")
