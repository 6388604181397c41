"""Where a reader has been and can go: histories, selections, lists of what is unfolded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.paths import folder_prefixes
from codeatlas.functions.tables import HISTORY


def history(events: DataFrame, key: str, order: str, what: str, target: str, capacity: int = HISTORY) -> DataFrame:
    """(key, entries, cursor) after events in order: ``push`` drops what lies ahead and adds its
    target (the oldest goes beyond the capacity), ``back`` and ``forward`` move where they can. The
    first push is the start. A key's events are folded inside its row."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(what).alias("what"), F.col(target).alias("target")))).alias("e"))
    kind = events.schema[target].dataType.simpleString()
    none = F.struct(F.array().cast(f"array<{kind}>").alias("entries"), F.lit(-1).alias("cursor"))

    def step(s: Column, e: Column) -> Column:
        pushed = F.concat(F.slice(s["entries"], F.lit(1), s["cursor"] + 1), F.array(e["target"]))
        kept = F.slice(pushed, F.greatest(F.size(pushed) - capacity, F.lit(0)) + 1, F.lit(capacity))
        last = F.size(s["entries"]) - 1
        # one structure: both of its fields read the state before the event
        return F.struct(
            F.when(e["what"] == "push", kept).otherwise(s["entries"]).alias("entries"),
            F.when(e["what"] == "push", F.size(kept) - 1).when(e["what"] == "back", F.greatest(s["cursor"] - 1, F.least(last, F.lit(0)))).when(e["what"] == "forward", F.least(s["cursor"] + 1, last)).otherwise(s["cursor"]).alias("cursor"),
        )

    return rows.select(key, F.aggregate("e", none, step).alias("s")).select(key, "s.entries", "s.cursor")


def move_selection(selection: Column, delta: Column, results: Column) -> Column:
    """The selected place after a step, around the ends; as it was where there is nothing."""
    return F.when(results > 0, F.pmod(selection + delta, results)).otherwise(selection)


def clamp_selection(selection: Column, results: Column) -> Column:
    """The selected place after a new search."""
    return F.least(selection, F.greatest(results - 1, F.lit(0)))


def candidates(nodes: DataFrame, mode: str, kind: str = "kind") -> DataFrame:
    """What a search looks through: files, or all but folders."""
    return nodes.where(F.col(kind) == "file" if mode == "file" else F.col(kind) != "folder")


def can_enter_calls(kind: Column, label: Column, children: Column) -> Column:
    """Whether a node can be the centre of a call graph: a function without parts."""
    return (kind == "item") & F.coalesce(label == "fn", F.lit(False)) & (children == 0)


def is_page(kind: Column, start: Column, children: Column) -> Column:
    """Whether a node is a leaf page: it has bytes and no children, and is no folder."""
    return start.isNotNull() & (children == 0) & (kind != "folder")


def unfolded(folders: DataFrame, path: str = "path", size: str = "bytes", expanded: str = "expanded") -> DataFrame:
    """Folders whose ancestors are all expanded, with their place in a depth-first list: siblings
    by size, largest first, then by name. ``order`` sorts the list; it holds a size and a path for
    each level, so no window over all folders is needed."""
    up = folders.select(F.col(path).alias("p"), F.posexplode(F.concat(folder_prefixes(path), F.array(path))).alias("level", "a"))
    known = folders.select(F.col(path).alias("a"), F.col(size).alias("s"), F.col(expanded).alias("x"))
    chain = up.join(known, "a").groupBy("p").agg(
        F.array_sort(F.collect_list(F.struct("level", (-F.col("s")).alias("s"), "a"))).alias("order"), F.bool_and(F.col("x") | (F.col("a") == F.col("p"))).alias("shown"), F.count("*").alias("n")
    )
    whole = chain.where("shown").where(F.col("n") == F.size(F.split("p", "/")))
    return whole.select(F.col("p").alias(path), F.transform("order", lambda o: F.struct(o["s"].alias("s"), o["a"].alias("a"))).alias("order"))


def last_visited(visits: DataFrame, parent: str, child: str, order: str) -> DataFrame:
    """The child of each parent that was visited last."""
    return visits.groupBy(parent).agg(F.max_by(child, order).alias(child))


def step_in(children: DataFrame, visited: DataFrame, parent: str, child: str, measure: str, place: str) -> DataFrame:
    """Where Enter leads from each parent: the child visited last if it is still there, else the one
    of largest measure (of equals the last in order)."""
    largest = children.groupBy(parent).agg(F.max_by(child, F.struct(measure, place)).alias("largest"))
    there = visited.join(children.select(parent, child), [parent, child], "left_semi").withColumnRenamed(child, "visited")
    return largest.join(there, parent, "left").select(parent, F.coalesce("visited", "largest").alias(child))


def add_absent(items: Column, new: Column, any_case: bool = False) -> Column:
    """A filter list with one entry more, unless it is there."""
    there = F.exists(items, lambda x: F.lower(x) == F.lower(new)) if any_case else F.array_contains(items, new)
    return F.when(there, items).otherwise(F.concat(items, F.array(new)))


def file_symbols(nodes: DataFrame) -> DataFrame:
    """(file, symbols) of (file, id, kind, byte_start): the items of each file with the byte where
    they begin, in order; a file without items stands for itself."""
    items = nodes.where("kind <> 'file' and byte_start is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("byte_start").alias("start"), "id"))).alias("symbols"))
    files = nodes.where("kind = 'file'").select("file", F.struct(F.col("byte_start").alias("start"), "id").alias("own"))
    own = F.when(F.col("own.start").isNull(), F.slice(F.array("own"), 1, 0)).otherwise(F.array("own"))
    return files.join(items, "file", "left").select("file", F.coalesce("symbols", own).alias("symbols"))


def card_lines(lines: DataFrame, cards: DataFrame, key: str, most: int) -> DataFrame:
    """The first lines of each card's function: ``cards`` has (card, key, first_line, measure)."""
    j = cards.join(lines, key).where(f"line_no >= first_line and line_no < first_line + least(measure, {most})")
    return j.select("card", (F.col("line_no") - F.col("first_line")).alias("row"), "text")
